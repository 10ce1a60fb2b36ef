"""DuckDB SQL for the registered queries, written from the derivations of the samples and not from the operators."""

from __future__ import annotations

E = """e0 AS (SELECT 'u' || user_id AS aggregate_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
  count(*) OVER (PARTITION BY user_id) AS n, ts, event_type AS src, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
e AS (SELECT *, CASE WHEN sequence = 1 THEN 'JourneyOpened' WHEN src = 'signup' THEN 'JourneyModified' WHEN src = 'click' THEN 'AttributesSet'
  WHEN src = 'view' THEN 'WorkflowEvaluated' WHEN src = 'error' THEN 'StepProgressed' WHEN sequence = n THEN 'JourneyClosed' ELSE 'AttributesSet' END AS event_type,
  CASE WHEN sequence > 1 AND src = 'view' AND k % 11 <> 0 THEN '1.1' ELSE '1.0' END AS event_version,
  CASE WHEN k % 11 <> 0 THEN 'phase_' || (k % 6) END AS ph FROM e0)"""
W = f"""{E}, w AS (
  SELECT aggregate_id, sequence, event_type, '/profile/k' AS path, CAST(k AS DOUBLE) AS value, false AS del FROM e WHERE event_type = 'JourneyModified'
  UNION ALL SELECT aggregate_id, sequence, event_type, '/profile/v', value, k % 10 = 0 FROM e WHERE event_type = 'JourneyModified'
  UNION ALL SELECT aggregate_id, sequence, event_type, '/profile/tags/x', CAST(k AS DOUBLE), k % 7 <> 0 FROM e WHERE event_type = 'JourneyModified'
  UNION ALL SELECT aggregate_id, sequence, event_type, '/profile/tags/' || i, CAST(k + i AS DOUBLE), k % 7 = 0 OR i >= k % 3 FROM e, (VALUES (0), (1)) AS t(i) WHERE event_type = 'JourneyModified'
  UNION ALL SELECT aggregate_id, sequence, event_type, '/search/k', CAST(k AS DOUBLE), false FROM e WHERE event_type = 'AttributesSet' AND src = 'click'
  UNION ALL SELECT aggregate_id, sequence, event_type, '/booking/value', value, false FROM e WHERE event_type = 'AttributesSet' AND src = 'click'
  UNION ALL SELECT aggregate_id, sequence, event_type, '/booking/last/amount', value, false FROM e WHERE event_type = 'AttributesSet' AND src = 'purchase')"""


def _bag(where: str = "true") -> str:
    return f"""bag AS (SELECT aggregate_id, path, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id, path ORDER BY sequence DESC) AS r FROM w WHERE {where}) WHERE r = 1 AND NOT del)"""


def _number(x: str) -> str:
    """A value of cents as JSON text."""
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def _scalars(source: str = "e") -> str:
    return f"""s AS (SELECT aggregate_id, CASE WHEN bool_or(event_type = 'JourneyClosed') THEN 'Complete' ELSE 'InProgress' END AS state, bool_or(event_type = 'JourneyOpened') AS started,
  arg_max('step_' || (k % 7), sequence) FILTER (WHERE event_type = 'StepProgressed') AS current_step, max(sequence) FILTER (WHERE event_type = 'WorkflowEvaluated') AS dseq,
  max(sequence) AS version, min(ts) AS created_at, max(ts) AS updated_at FROM {source} GROUP BY aggregate_id),
sd AS (SELECT s.*, d.ph AS phase, CASE WHEN d.k IS NOT NULL THEN 'a' || (d.k % 5) END AS actions FROM s LEFT JOIN e d ON d.aggregate_id = s.aggregate_id AND d.sequence = s.dseq)"""


C = f"""{E}, c AS (SELECT aggregate_id, sequence, value AS amount, k,
  CASE WHEN sequence = 1 AND user_id % 10 <> 0 THEN 'Start' WHEN src = 'signup' THEN 'CapturePerson' WHEN src = 'click' THEN 'SetAttributes' WHEN src = 'view' THEN 'Capture'
    WHEN src = 'error' THEN 'CapturePersonDetails' WHEN k % 20 = 0 THEN 'Complete' ELSE 'SetAttributes' END AS command,
  CASE WHEN sequence = 1 AND user_id % 10 <> 0 THEN NULL WHEN src = 'signup' THEN 'p' || (k % 3) WHEN src = 'error' THEN 'p' || (k % 4) WHEN src = 'click' AND k % 10 = 2 THEN 'p' || (k % 4) END AS person_ref,
  CASE WHEN src = 'signup' AND NOT (sequence = 1 AND user_id % 10 <> 0) THEN 's' || (user_id + k % 4) END AS subject_id,
  CASE WHEN sequence = 1 AND user_id % 10 <> 0 THEN NULL WHEN src = 'click' THEN CASE k % 10 WHEN 0 THEN '/searh/k' WHEN 1 THEN NULL WHEN 2 THEN '/persons/p' || (k % 4) || '/passportNumber' ELSE '/search/k' END
    WHEN src = 'purchase' AND k % 20 <> 0 THEN '/booking/amount' END AS path,
  CASE WHEN src = 'view' AND NOT (sequence = 1 AND user_id % 10 <> 0) THEN 'step_' || (k % 7) END AS step FROM e)"""
CLASS = "CASE WHEN path LIKE '/persons/%' THEN 'secret' WHEN path LIKE '/search/%' OR path LIKE '/booking/%' THEN 'plaintext' ELSE 'unknown' END"
CHANGES = f"""{C}, caps AS (SELECT aggregate_id, person_ref, min(sequence) AS captured_at, arg_min(subject_id, sequence) AS subject_id FROM c WHERE command = 'CapturePerson' GROUP BY ALL),
ch AS (SELECT c.aggregate_id, c.sequence, c.path, regexp_extract(c.path, '^/[^/]*/([^/]*)', 1) AS ref, {CLASS.replace("path", "c.path")} AS class FROM c WHERE command = 'SetAttributes' AND path IS NOT NULL),
cl AS (SELECT ch.*, CASE WHEN class <> 'secret' THEN class WHEN caps.captured_at < ch.sequence THEN 'secret' ELSE 'unbound' END AS bucket, caps.subject_id AS slot_subject
  FROM ch LEFT JOIN caps ON caps.aggregate_id = ch.aggregate_id AND caps.person_ref = ch.ref)"""
#: Admission by correlated look-ups of what came before.
ADMIT = f"""{C}, st AS (SELECT aggregate_id, min(sequence) FILTER (WHERE command = 'Start') AS s0 FROM c GROUP BY 1),
co AS (SELECT c.aggregate_id, min(c.sequence) AS c0 FROM c JOIN st USING (aggregate_id) WHERE command = 'Complete' AND c.sequence > st.s0 GROUP BY 1),
g AS (SELECT c.*, coalesce(st.s0 < c.sequence, false) AS started, coalesce(co.c0 < c.sequence, false) AS completed FROM c LEFT JOIN st USING (aggregate_id) LEFT JOIN co USING (aggregate_id)),
b AS (SELECT aggregate_id, person_ref, min(sequence) AS b0, arg_min(subject_id, sequence) AS bs FROM g WHERE command = 'CapturePerson' AND started AND NOT completed GROUP BY ALL),
a AS (SELECT g.*, CASE WHEN b.b0 <= g.sequence THEN b.bs END AS slot_subject,
  CASE WHEN command = 'Start' THEN CASE WHEN started THEN 'AlreadyStarted' END WHEN NOT started THEN 'NotFound' WHEN completed THEN 'AlreadyCompleted'
    WHEN command = 'CapturePerson' AND b.b0 <= g.sequence AND b.bs <> g.subject_id THEN 'PersonRefConflict'
    WHEN command = 'CapturePersonDetails' AND (b.b0 IS NULL OR b.b0 > g.sequence) THEN 'PersonNotFound'
    WHEN command = 'SetAttributes' THEN CASE WHEN path IS NULL THEN 'InvalidData' WHEN {CLASS} = 'unknown' THEN 'UnknownAttributePath' WHEN path LIKE '/persons/%' AND (b.b0 IS NULL OR b.b0 > g.sequence) THEN 'PersonNotFound' END END AS error
  FROM g LEFT JOIN b ON b.aggregate_id = g.aggregate_id AND b.person_ref = g.person_ref)"""

P = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT l_orderkey, count(*) AS m FROM l GROUP BY 1),
lead_ AS (SELECT 'o' || o_orderkey AS aggregate_id, o_orderdate AS ts, 2 AS sequence, 'lead' AS person_ref, 'c' || o_custkey AS subject_id, c_name AS name, 'User' || (o_custkey % 1000) || '@Mail.example.com' AS email, CASE WHEN o_custkey % 2 = 0 THEN '+' || o_custkey END AS phone
  FROM orders JOIN customer ON o_custkey = c_custkey),
agent_ AS (SELECT 'o' || l_orderkey AS aggregate_id, o_orderdate AS ts, 3 AS sequence, 'agent' AS person_ref, 's' || l_suppkey AS subject_id, s_name AS name, 'Agent' || s_suppkey || '@mail.example.com' AS email, CAST(NULL AS VARCHAR) AS phone
  FROM l JOIN supplier ON l_suppkey = s_suppkey WHERE n = 1),
cap AS (SELECT * FROM lead_ UNION ALL SELECT * FROM agent_),
att AS (SELECT 'o' || l_orderkey AS aggregate_id, n + 3 AS sequence, 'lead' AS label, '/persons/lead/passportNumber' AS path, 'P' || l_partkey AS value FROM l
  UNION ALL SELECT 'o' || l_orderkey, n + 3, 'agent', '/persons/agent/passportNumber', 'Q' || l_partkey FROM l WHERE l_linenumber % 2 = 0),
pa AS (SELECT aggregate_id, sequence, subject_id, 'default' AS label FROM cap UNION ALL SELECT att.aggregate_id, att.sequence, cap.subject_id, att.label FROM att JOIN cap ON cap.aggregate_id = att.aggregate_id AND cap.person_ref = att.label),
er AS (SELECT 'c' || c_custkey AS subject_id FROM customer WHERE c_custkey % 10 = 3 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 1),
ks AS (SELECT 'c' || c_custkey AS subject_id, CASE WHEN c_custkey % 3 = 0 THEN 'v1' ELSE 'v2' END AS kek_id FROM customer UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'v1' ELSE 'v2' END FROM supplier),
em AS (SELECT lower('user' || (c_custkey % 1000) || '@mail.example.com') AS e FROM customer WHERE c_custkey % 50 = 7),
lk AS (SELECT DISTINCT subject_id, lower(email) AS email_lower FROM cap)"""

S = """sb AS (SELECT 'o' || o_orderkey AS aggregate_id, o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN n_name END AS origin, 'N' || (o_orderkey % 25) AS destination,
  CASE o_orderkey % 3 WHEN 0 THEN 'one-way' WHEN 1 THEN 'round-trip' ELSE 'multi-city' END AS trip_type, CASE WHEN o_orderkey % 5 <> 0 THEN 'F' || (o_orderkey % 100) END AS outbound,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'R' || (o_orderkey % 100) END AS return_flight, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'pending' END AS payment_status,
  CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE 1 + o_orderkey % 2 END AS adults, o_orderkey % 2 AS children, o_orderkey % 4 AS n_persons,
  CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 4 > 0 THEN 1 ELSE 0 END AS n_untyped, CAST(o_orderdate AS DATE) + 30 AS departure_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

T = """t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'business' WHEN 2 THEN 'premium-economy' ELSE 'economy' END AS cabin,
  (l_partkey * 37) % 4000 AS distance, l_extendedprice AS fare0, CAST(l_shipdate AS DATE) AS dep, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS ahead, CAST(l_quantity AS INTEGER) % 4 AS bags, l_quantity AS weight,
  CASE WHEN cn.n_nationkey = 0 THEN 'US' ELSE cn.n_name END AS dc, CASE WHEN sn.n_nationkey = 0 THEN 'US' ELSE sn.n_name END AS ac, o_orderpriority AS pr, 1 + l_orderkey % 4 AS pax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey),
t1 AS (SELECT *, CASE cabin WHEN 'first' THEN CASE WHEN distance <= 2000 THEN 3.5 ELSE 4.2 END WHEN 'business' THEN CASE WHEN distance <= 2000 THEN 2.1 ELSE 2.8 END WHEN 'premium-economy' THEN 1.4 ELSE 1.0 END::DOUBLE AS multiplier,
  CASE WHEN cabin = 'premium-economy' AND ahead > 21 THEN 0.05 WHEN cabin = 'economy' AND ahead > 14 THEN 0.1 ELSE 0 END::DOUBLE AS discount,
  CASE WHEN month(dep) IN (6, 7, 8, 12) THEN 1.25 WHEN month(dep) IN (4, 5, 9, 10) THEN 1.1 ELSE 0.9 END::DOUBLE AS seasonal,
  CASE WHEN month(dep) IN (1, 2, 3, 11) AND dayofweek(dep) IN (0, 6) THEN 25 ELSE 0 END::DOUBLE AS surcharge,
  (CASE WHEN cabin = 'economy' AND bags = 1 AND weight <= 23 AND distance <= 2000 THEN 25 ELSE 0 END + CASE WHEN cabin = 'economy' AND bags = 2 AND weight <= 23 THEN 35 ELSE 0 END + CASE WHEN weight > 23 AND weight <= 32 THEN 100 ELSE 0 END + CASE WHEN weight > 32 THEN 200 ELSE 0 END)::DOUBLE AS baggage_fees,
  (CASE WHEN l_partkey % 2 = 1 AND cabin = 'economy' THEN 15 ELSE 0 END + CASE WHEN (l_partkey // 2) % 2 = 1 AND cabin = 'economy' THEN 35 ELSE 0 END + CASE WHEN (l_partkey // 4) % 2 = 1 AND cabin LIKE '%economy' THEN 20 ELSE 0 END
   + CASE WHEN (l_partkey // 8) % 2 = 1 AND cabin = 'economy' AND distance > 1000 THEN 12 ELSE 0 END + CASE WHEN (l_partkey // 16) % 2 = 1 AND distance > 500 THEN 8 ELSE 0 END + CASE WHEN (l_partkey // 32) % 2 = 1 AND cabin LIKE '%economy' THEN 45 ELSE 0 END)::DOUBLE AS ancillary_fees,
  (CASE WHEN dc = 'US' THEN 11.2 ELSE 0 END + CASE WHEN dc = 'US' AND ac <> 'US' THEN 7 ELSE 0 END + CASE WHEN dc <> 'US' AND ac = 'US' THEN 18.3 ELSE 0 END + CASE WHEN dc = ac THEN 15 ELSE 45 END)::DOUBLE AS tax_total,
  (CASE WHEN pr = '1-URGENT' AND fare0 < 1000 THEN 25 * pax WHEN pr = '2-HIGH' AND fare0 BETWEEN 1000 AND 5000 THEN 45 * pax WHEN pr = '3-MEDIUM' AND fare0 > 5000 THEN 75 * pax ELSE 0 END)::DOUBLE AS insurance_fee FROM t)"""
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
X = """x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['validation','payment','availability','system','timeout','business_rule','unknown'][l_linenumber % 7 + 1] AS error_type, l_partkey % 6 AS d,
  l_suppkey % 3 <> 0 AS card, l_suppkey % 4 AS sev, l_suppkey % 3 AS s3, ['search_criteria','passenger_details','flight_search_results','seat_selection','payment'][l_orderkey % 5 + 1] AS step, CAST(l_quantity AS INTEGER) % 5 AS retry FROM lineitem),
y AS (SELECT *, CASE WHEN error_type IN ('validation', 'payment', 'availability', 'business_rule') THEN error_type ELSE 'system' END AS branch FROM x),
z AS (SELECT *, CASE branch
  WHEN 'validation' THEN CASE WHEN d IN (0, 4) AND step = 'search_criteria' AND retry < 3 THEN 1 WHEN d = 1 AND step = 'search_criteria' AND retry < 5 THEN 2 WHEN d IN (2, 3) AND step = 'search_criteria' THEN 3 WHEN d IN (2, 3) AND step = 'passenger_details' AND retry < 3 THEN 4 WHEN retry >= 3 THEN 5 END
  WHEN 'payment' THEN CASE WHEN d IN (0, 4) AND card AND retry < 2 THEN 11 WHEN d = 1 AND card THEN 12 WHEN d = 2 THEN 13 WHEN d = 3 AND retry < 3 THEN 14 WHEN retry >= 3 THEN 15 END
  WHEN 'availability' THEN CASE WHEN d = 0 AND step = 'flight_search_results' THEN 21 WHEN d = 1 AND step = 'seat_selection' THEN 22 WHEN d = 2 AND step = 'payment' THEN 23 WHEN d = 3 THEN 24 WHEN d = 4 THEN 25 END
  WHEN 'business_rule' THEN CASE WHEN d = 0 AND s3 = 0 THEN 41 WHEN d = 1 AND s3 = 1 THEN 42 WHEN d = 2 THEN 43 WHEN d = 3 THEN 44 WHEN d = 4 THEN 45 END
  ELSE CASE WHEN d IN (0, 4) AND sev IN (2, 3) THEN 31 WHEN d = 1 AND sev = 1 AND s3 = 1 THEN 32 WHEN d = 2 AND sev = 0 AND s3 = 0 THEN 33 WHEN sev = 3 AND s3 = 2 THEN 34 END END AS rule FROM y),
ru(rule, action, next_step, extra) AS (VALUES (1,'suggest_airports','search_criteria','false'),(2,'show_date_picker','search_criteria','false'),(3,'redirect_group_booking','group_booking','false'),(4,'highlight_required_fields','passenger_details','false'),(5,'offer_assistance','=','true'),
  (11,'suggest_alternative_payment','alternative_payment_methods','15'),(12,'request_updated_card','payment','10'),(13,'require_verification','payment','30'),(14,'retry_after_delay','payment','20'),(15,'escalate_to_support','booking_summary','1440'),
  (21,'show_alternative_flights','flight_search_results','true'),(22,'refresh_seat_map','seat_selection','true'),(23,'display_fare_change','booking_summary','false'),(24,'show_schedule_options','flight_search_results','true'),(25,'restart_booking_flow','search_criteria','false'),
  (31,'queue_request_for_retry','=','high'),(32,'retry_with_fallback','=','medium'),(33,'bypass_cache','=','low'),(34,'activate_maintenance_mode','system_maintenance','critical'),
  (41,'show_minor_services','unaccompanied_minor_services','true'),(42,'suggest_infant_seat','passenger_details','false'),(43,'show_visa_requirements','passenger_details','true'),(44,'suggest_alternative_dates','search_criteria','false'),(45,'show_health_requirements','passenger_details','true')),
r AS (SELECT z.*, ru.action, CASE WHEN ru.next_step = '=' THEN z.step ELSE ru.next_step END AS next_step, ru.extra FROM z LEFT JOIN ru USING (rule))"""


def _payloads(erased: str) -> str:
    """Every event of the personal log; data of the subjects in erased is redacted."""
    keep = lambda who, text, gone: f"CASE WHEN {who} IN (SELECT subject_id FROM {erased}) THEN {gone} ELSE {text} END"
    return f"""WITH {P}, nobody AS (SELECT subject_id FROM er WHERE false),
st AS (SELECT 'o' || l_orderkey AS aggregate_id, n + 3 AS sequence, l_extendedprice AS price, 'P' || l_partkey AS lv, CASE WHEN l_linenumber % 2 = 0 THEN 'Q' || l_partkey END AS av, c.subject_id AS ls, a.subject_id AS asub
  FROM l JOIN lead_ c ON c.aggregate_id = 'o' || l_orderkey JOIN agent_ a ON a.aggregate_id = 'o' || l_orderkey),
bad AS (SELECT aggregate_id, sequence, CASE WHEN ls IN (SELECT subject_id FROM {erased}) OR (av IS NOT NULL AND asub IN (SELECT subject_id FROM {erased})) THEN 'redacted' ELSE 'decrypted' END AS status FROM st),
none AS (SELECT 'o' || o_orderkey AS aggregate_id, 1 AS sequence, 'JourneyOpened' AS event_type FROM orders UNION ALL SELECT 'o' || o_orderkey, coalesce(m, -1) + 4, 'JourneyClosed' FROM orders LEFT JOIN m ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
SELECT aggregate_id, CAST(sequence AS BIGINT) AS sequence, event_type, 'plain' AS status, CAST(NULL AS VARCHAR) AS subject_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS DOUBLE) AS price,
  CAST(NULL AS VARCHAR) AS lead_path, CAST(NULL AS VARCHAR) AS lead_value, CAST(NULL AS VARCHAR) AS agent_path, CAST(NULL AS VARCHAR) AS agent_value FROM none
UNION ALL SELECT aggregate_id, sequence, 'PersonCaptured', {keep('subject_id', "'decrypted'", "'redacted'")}, subject_id, {keep('subject_id', 'name', "'[redacted]'")}, {keep('subject_id', 'email', "'[redacted]'")}, {keep('subject_id', 'phone', 'NULL')}, NULL, NULL, NULL, NULL, NULL FROM cap
UNION ALL SELECT st.aggregate_id, st.sequence, 'AttributesSet', bad.status, NULL, NULL, NULL, NULL, price, {keep('ls', "'/persons/lead/passportNumber'", "'/redacted'")}, {keep('ls', 'lv', "'true'")},
  CASE WHEN av IS NOT NULL THEN {keep('asub', "'/persons/agent/passportNumber'", "'/redacted'")} END, CASE WHEN av IS NOT NULL THEN {keep('asub', 'av', "'true'")} END FROM st JOIN bad USING (aggregate_id, sequence)"""


def _price(cols: str) -> str:
    return f"WITH {T} SELECT {KEY}, {cols} FROM t1"


def _recovery(branch: str) -> str:
    return f"WITH {X} SELECT {KEY}, action, next_step, extra FROM r WHERE branch = '{branch}'"


def _verdicts(command: str) -> str:
    return f"WITH {ADMIT} SELECT aggregate_id, sequence, error FROM a WHERE command = '{command}'"


PHASE = """CASE WHEN payment_status = 'completed' THEN 1 WHEN origin IS NULL THEN 2 WHEN outbound IS NULL THEN 3 WHEN trip_type = 'round-trip' AND return_flight IS NULL THEN 4
  WHEN NOT (n_persons >= adults + children AND n_persons > 0 AND n_untyped = 0) THEN 5 ELSE 6 END"""
FLAT = """fl AS (SELECT aggregate_id, '/search/tripType' AS path, trip_type AS value FROM sb UNION ALL SELECT aggregate_id, '/search/origin', origin FROM sb WHERE origin IS NOT NULL
  UNION ALL SELECT aggregate_id, '/search/destination', destination FROM sb UNION ALL SELECT aggregate_id, '/search/departureDate', CAST(departure_date AS VARCHAR) FROM sb
  UNION ALL SELECT aggregate_id, '/search/passengers/adults', CAST(adults AS VARCHAR) FROM sb UNION ALL SELECT aggregate_id, '/search/passengers/children', CAST(children AS VARCHAR) FROM sb
  UNION ALL SELECT aggregate_id, '/booking/selectedOutboundFlight', outbound FROM sb WHERE outbound IS NOT NULL UNION ALL SELECT aggregate_id, '/booking/selectedReturnFlight', return_flight FROM sb WHERE return_flight IS NOT NULL
  UNION ALL SELECT aggregate_id, '/booking/paymentStatus', payment_status FROM sb)"""
PERSONS = f"""{P}, pe AS (SELECT cap.aggregate_id, cap.person_ref, cap.subject_id, er.subject_id IS NOT NULL AS forgotten, CASE WHEN er.subject_id IS NULL THEN name END AS name, CASE WHEN er.subject_id IS NULL THEN email END AS email, CASE WHEN er.subject_id IS NULL THEN phone END AS phone
  FROM cap LEFT JOIN er ON er.subject_id = cap.subject_id)"""

PHASES = "['booking_confirmed','collecting_search','selecting_outbound','selecting_return','collecting_passengers','collecting_payment'][r] AS phase, ['booking_confirmation','','flight_search_results','return_flight_selection,flight_search_results','passenger_details','seat_selection,passenger_details'][r] AS actions"

def _pad(byte: int) -> str:
    """The key of C21 as one of the two pads of an HMAC, in hexadecimal."""
    return bytes(b ^ byte for b in b"namespace".ljust(64, b"\0")).hex()


ORACLE_SQL: dict[str, str] = {
    "R1_evaluate_attributes": f"""WITH {S}, s2 AS (SELECT * REPLACE (coalesce(origin, 'NEW') AS origin, CASE WHEN k % 10 = 3 THEN NULL ELSE outbound END AS outbound) FROM sb), ph AS (SELECT aggregate_id, {PHASE} AS r FROM s2) SELECT aggregate_id, {PHASES} FROM ph""",
    "R2_evaluate_next_steps": f"""WITH {S}, s2 AS (SELECT * REPLACE (coalesce(origin, 'NEW') AS origin, CASE WHEN k % 10 = 3 THEN NULL ELSE outbound END AS outbound) FROM sb), ph AS (SELECT aggregate_id, {PHASE} AS r FROM s2) SELECT ph.aggregate_id, 'step_' || n_persons AS current_step, {PHASES} FROM ph JOIN sb USING (aggregate_id)""",
    "V2_validate_after_merge": f"WITH {S} SELECT aggregate_id, coalesce(origin, 'NEW') AS origin, adults >= 0 AS valid FROM sb",
    "S9_command_source": f"WITH {C} SELECT aggregate_id, sequence, command, step, '/journeys' AS uri FROM c",
    "R5_decision_table_collect": f"""WITH {T}, f AS (SELECT 'Seat Selection' AS kind, 15 AS amount FROM t1 WHERE l_partkey % 2 = 1 AND cabin = 'economy' UNION ALL SELECT 'Premium Seat Selection', 35 FROM t1 WHERE (l_partkey // 2) % 2 = 1 AND cabin = 'economy'
  UNION ALL SELECT 'Priority Boarding', 20 FROM t1 WHERE (l_partkey // 4) % 2 = 1 AND cabin LIKE '%economy' UNION ALL SELECT 'Meal Selection', 12 FROM t1 WHERE (l_partkey // 8) % 2 = 1 AND cabin = 'economy' AND distance > 1000
  UNION ALL SELECT 'WiFi Access', 8 FROM t1 WHERE (l_partkey // 16) % 2 = 1 AND distance > 500 UNION ALL SELECT 'Lounge Access', 45 FROM t1 WHERE (l_partkey // 32) % 2 = 1 AND cabin LIKE '%economy') SELECT kind, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM f GROUP BY 1""",
    "S1_scan_event_log": f"WITH {E} SELECT aggregate_id, sequence, event_type, event_version, ts AS timestamp FROM e",
    "S2_scan_aggregate": f"WITH {E} SELECT aggregate_id, sequence, event_type FROM e WHERE user_id = 8",
    "S3_tail_after": f"WITH {E} SELECT aggregate_id, sequence, event_type FROM e WHERE user_id % 10 = 7 OR sequence > n // 2",
    "S3_tail_last": f"WITH {E} SELECT aggregate_id, sequence, event_type FROM e WHERE sequence > n - 3",
    "S4_scan_all_decrypted": f"WITH {P} SELECT aggregate_id, CAST(sequence AS BIGINT) AS sequence, subject_id, name, email, phone FROM cap",
    "S6_latest_snapshot": f"WITH {W}, {_bag()} SELECT * FROM bag",
    "S10_parse_event_variant": f"""WITH {E} SELECT aggregate_id, sequence, CASE WHEN event_type = 'JourneyModified' THEN 'profile' END AS step, CASE WHEN event_type = 'StepProgressed' THEN 'step_' || (k % 7) END AS to_step,
  CASE WHEN event_type = 'WorkflowEvaluated' THEN ph END AS phase, CASE WHEN event_type = 'WorkflowEvaluated' THEN 'a' || (k % 5) END AS actions, event_type = 'JourneyClosed' AS is_completed FROM e""",
    "S10_parse_person_events": f"""WITH {ADMIT}, ok AS (SELECT * FROM a WHERE error IS NULL AND command IN ('CapturePerson', 'CapturePersonDetails', 'Complete'))
  SELECT aggregate_id, sequence, CASE command WHEN 'CapturePerson' THEN 'PersonCaptured' WHEN 'Complete' THEN 'SubjectForgotten' ELSE 'PersonDetailsUpdated' END AS event_type, CASE WHEN command <> 'Complete' THEN person_ref END AS person_ref,
  CASE command WHEN 'CapturePerson' THEN subject_id WHEN 'Complete' THEN 's' || k ELSE slot_subject END AS subject_id, CASE WHEN command = 'CapturePerson' THEN 'N' || k END AS name, CASE WHEN command = 'CapturePerson' THEN 'M' || k || '@x.org' END AS email,
  CASE WHEN command = 'CapturePerson' AND k % 2 = 0 THEN '+' || k END AS phone, CASE WHEN command = 'CapturePersonDetails' THEN CASE WHEN k % 4 = 0 THEN 'null' ELSE '{{"seat":' || k || '}}' END END AS data FROM ok""",
    "C1_details_partitions": f"""WITH {ADMIT} SELECT aggregate_id, sequence, slot_subject AS subject_id, CASE WHEN slot_subject LIKE '%3' THEN '{{}}' ELSE '{{"seat":' || k || '}}' END AS data,
  CASE WHEN slot_subject LIKE '%3' THEN 'redacted' ELSE 'decrypted' END AS status FROM a WHERE error IS NULL AND command = 'CapturePersonDetails' AND k % 4 <> 0""",
    "W2_check_append_conflicts": f"""WITH {E}, ba AS (SELECT aggregate_id, sequence FROM e WHERE sequence BETWEEN 40 AND 45 UNION ALL SELECT aggregate_id, sequence FROM e WHERE sequence = 44 AND user_id % 10 = 5)
  SELECT aggregate_id, sequence, sequence <= 42 OR count(*) OVER (PARTITION BY aggregate_id, sequence) > 1 AS conflict FROM ba""",
    "W3_check_sequence_gaps": f"""WITH {E} SELECT b.aggregate_id, b.sequence, 'gap' AS problem FROM e b LEFT JOIN e p ON p.aggregate_id = b.aggregate_id AND p.sequence = b.sequence - 1
  WHERE b.event_type <> 'StepProgressed' AND p.event_type = 'StepProgressed'""",
    "W6_audit_log": f"""WITH {E} SELECT aggregate_id || '-' || sequence AS event, 'StepProgressed {{"StepProgressed":{{"to_step":"step_' || (k % 7) || '"}}}}' AS line FROM e WHERE event_type = 'StepProgressed'""",
    "J1_flatten_json": f"WITH {S}, {FLAT} SELECT aggregate_id, path, value, false AS is_null FROM fl",
    "J2_assign_all": f"WITH {W}, {_bag("event_type = 'AttributesSet'")} SELECT * FROM bag",
    "J2_rehydrate_json": f"""WITH {S} SELECT aggregate_id, '{{"booking":{{"paymentStatus":"' || payment_status || '"' || coalesce(',"selectedOutboundFlight":"' || outbound || '"', '') || coalesce(',"selectedReturnFlight":"' || return_flight || '"', '')
    || '}},"search":{{"departureDate":"' || departure_date || '","destination":"' || destination || '"' || coalesce(',"origin":"' || origin || '"', '') || ',"passengers":{{"adults":' || adults || ',"children":' || children || '}},"tripType":"' || trip_type || '"}}}}' AS document FROM sb""",
    "J2_array_positions": f"""WITH RECURSIVE {E}, ops AS (SELECT aggregate_id, sequence, k, CASE WHEN sequence = 1 OR k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 0 WHEN k % 4 = 2 THEN 1 ELSE k % 9 END AS place FROM e),
  r AS (SELECT aggregate_id, sequence, [k] AS l, 0 AS n_errors, CAST(NULL AS VARCHAR) AS first_error FROM ops WHERE sequence = 1
    UNION ALL SELECT o.aggregate_id, o.sequence, CASE WHEN place > len(l) THEN l WHEN coalesce(place, len(l)) = len(l) THEN list_append(l, k) ELSE l[1:place] || [k] || l[place + 2:] END,
      n_errors + CASE WHEN place > len(l) THEN 1 ELSE 0 END, coalesce(first_error, CASE WHEN place > len(l) THEN 'OutOfBounds: ' || place END) FROM r JOIN ops o ON o.aggregate_id = r.aggregate_id AND o.sequence = r.sequence + 1)
  SELECT aggregate_id, '{{"list":[' || array_to_string(l, ',') || ']}}' AS document, CAST(n_errors AS BIGINT) AS n_errors, first_error FROM r QUALIFY sequence = max(sequence) OVER (PARTITION BY aggregate_id)""",
    "J3_merge_patch": f"WITH {W}, {_bag("event_type = 'JourneyModified'")} SELECT * FROM bag",
    "J4_shallow_merge": f"""WITH {W}, f AS (SELECT *, split_part(path, '/', 2) AS top FROM w WHERE event_type = 'AttributesSet') SELECT aggregate_id, path, round(value, 4) AS value FROM f
  WHERE sequence = (SELECT max(sequence) FROM f g WHERE g.aggregate_id = f.aggregate_id AND g.top = f.top)""",
    "J5_json_get": f"WITH {E} SELECT aggregate_id, sequence, 'step_' || (k % 7) AS to_step FROM e WHERE event_type = 'StepProgressed'",
    "J6_json_array_contains": f"WITH {E} SELECT aggregate_id, sequence FROM e WHERE event_type = 'WorkflowEvaluated' AND k % 5 = 3",
    "J7_pointer_tokens": "SELECT p_partkey, 2 AS n, 'part/' || replace(p_name, ' ', '~') AS first, true AS round_trip FROM part",
    "J8_pointer_strip_prefix": f"WITH {C} SELECT aggregate_id, sequence, CASE WHEN path LIKE '/persons/%' THEN '/passportNumber' END AS below FROM c WHERE path IS NOT NULL",
    "J10_typed_view_of_bag": f"""WITH {S} SELECT aggregate_id, trip_type AS "tripType", origin, CAST(adults AS INTEGER) AS adults, payment_status AS "paymentStatus" FROM sb""",
    "J11_values_of_map": f"WITH {S} SELECT aggregate_id, concat_ws(',', outbound, return_flight, payment_status) AS vals FROM sb",
    "A1_classify_path": f"WITH {C} SELECT path, {CLASS} AS class, count(*) AS n FROM c WHERE path IS NOT NULL GROUP BY ALL",
    "A2_secret_subject_path": f"WITH {C} SELECT aggregate_id, sequence, '/persons/' || person_ref AS slot FROM c WHERE path LIKE '/persons/%'",
    "A3_classify_changes": f"WITH {CHANGES} SELECT aggregate_id, sequence, path, bucket, CASE WHEN bucket = 'secret' THEN slot_subject END AS subject_id FROM cl",
    "A4_reject_unknown_paths": f"WITH {CHANGES} SELECT aggregate_id, sequence, path AS unknown_paths FROM cl WHERE bucket = 'unknown'",
    "A5_reject_unbound_secrets": f"WITH {CHANGES} SELECT aggregate_id, sequence, ref AS unbound_ref FROM cl WHERE bucket = 'unbound'",
    "A6_build_secret_partitions": f"WITH {CHANGES} SELECT aggregate_id, sequence, slot_subject AS subject_id, ref AS label FROM cl WHERE bucket = 'secret'",
    "A7_known_paths": f"WITH {C} SELECT DISTINCT path FROM c WHERE path IS NOT NULL AND {CLASS} = 'unknown'",
    "A8_pii_inventory": f"WITH {C} SELECT {CLASS} AS class, split_part(path, '/', 2) AS prefix, count(*) AS n FROM c WHERE path IS NOT NULL GROUP BY ALL",
    "V1_validate_json_schema": f"""WITH {S} SELECT aggregate_id, origin IS NOT NULL AND adults >= 0 AS valid, CASE WHEN adults < 0 AND origin IS NULL THEN '/search required:origin;/search/passengers/adults minimum'
  WHEN adults < 0 THEN '/search/passengers/adults minimum' WHEN origin IS NULL THEN '/search required:origin' ELSE '' END AS errors FROM sb""",
    "V4_check_state_domain": f"WITH {E}, {_scalars()} SELECT state, count(*) AS n, 0 AS n_violations FROM s GROUP BY 1",
    "K1_admit_start": _verdicts("Start"),
    "K2_admit_capture_person": _verdicts("CapturePerson"),
    "K3_admit_capture_details": _verdicts("CapturePersonDetails"),
    "K4_admit_capture": _verdicts("Capture"),
    "K5_admit_set_attributes": _verdicts("SetAttributes"),
    "K6_admit_complete": _verdicts("Complete"),
    "K7_admit_forget_subject": f"WITH {P} SELECT DISTINCT aggregate_id, subject_id FROM cap WHERE subject_id IN (SELECT subject_id FROM er)",
    "K7_forget_in_sequence": f"""WITH {ADMIT}, f0 AS (SELECT aggregate_id, sequence, started, 's' || (CAST(substr(aggregate_id, 2) AS BIGINT) + k % 4) AS subject_id FROM g WHERE command = 'CapturePersonDetails' AND k % 2 = 0),
  f AS (SELECT *, max(CASE WHEN started THEN sequence END) OVER (PARTITION BY aggregate_id, subject_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM f0)
  SELECT f.aggregate_id, f.sequence, f.subject_id, CASE WHEN NOT f.started THEN 'NotFound' END AS error, CASE WHEN f.started THEN count(b.b0) > 0 END AS forgets
  FROM f LEFT JOIN b ON b.aggregate_id = f.aggregate_id AND b.bs = f.subject_id AND b.b0 < f.sequence AND b.b0 > coalesce(f.previous, -1) GROUP BY f.aggregate_id, f.sequence, f.subject_id, f.started""",
    "K8_emitted_events": f"""WITH {ADMIT}, ok AS (SELECT *, lag(step) OVER (PARTITION BY aggregate_id, command ORDER BY sequence) AS from_step FROM a WHERE error IS NULL),
  ev AS (SELECT aggregate_id, CASE command WHEN 'Start' THEN 'JourneyOpened' WHEN 'CapturePerson' THEN 'PersonCaptured' WHEN 'CapturePersonDetails' THEN 'PersonDetailsUpdated' WHEN 'SetAttributes' THEN 'AttributesSet' WHEN 'Complete' THEN 'JourneyClosed' ELSE 'JourneyModified' END AS event_type FROM ok
    UNION ALL SELECT aggregate_id, 'WorkflowEvaluated' FROM ok WHERE command IN ('SetAttributes', 'Capture') UNION ALL SELECT aggregate_id, 'StepProgressed' FROM ok WHERE command = 'Capture' AND step IS DISTINCT FROM from_step)
  SELECT aggregate_id, event_type, count(*) AS n FROM ev GROUP BY ALL""",
    "K10_error_summary": f"WITH {ADMIT} SELECT command, error, count(*) AS n FROM a WHERE error IS NOT NULL GROUP BY ALL",
    "F1_replay_state": f"""WITH {W}, {_bag()}, {_scalars()}, bg AS (SELECT aggregate_id, count(*) AS bag_size, string_agg(path, ',' ORDER BY path) AS bag_paths, round(sum(value), 2) AS bag_total FROM bag GROUP BY 1)
  SELECT sd.aggregate_id, state, current_step, phase, actions, version, coalesce(bag_size, 0) AS bag_size, coalesce(bag_paths, '') AS bag_paths, bag_total FROM sd LEFT JOIN bg USING (aggregate_id)""",
    "F3_fold_bag": f"WITH {W}, {_bag()} SELECT * FROM bag",
    "F5_fold_person_captured": f"WITH {P} SELECT aggregate_id, person_ref, subject_id, name, email FROM cap",
    "F7_fold_workflow": f"WITH {E}, {_scalars()} SELECT aggregate_id, phase, actions FROM sd",
    "F8_fold_step": f"WITH {E}, {_scalars()} SELECT aggregate_id, current_step FROM s",
    "F9_fold_completed": f"WITH {E}, {_scalars()} SELECT aggregate_id, state, started FROM s",
    "F10_replay_as_of": f"WITH {W}, pt AS (SELECT aggregate_id, max(sequence) * 2 // 3 AS upto FROM e GROUP BY 1), e2 AS (SELECT e.* FROM e JOIN pt USING (aggregate_id) WHERE sequence <= upto), {_bag('sequence <= (SELECT upto FROM pt WHERE pt.aggregate_id = w.aggregate_id)')}, {_scalars('e2')} SELECT aggregate_id, state, current_step, phase, version, (SELECT count(*) FROM bag WHERE bag.aggregate_id = sd.aggregate_id) AS bag_size FROM sd",
    "F11_state_history": f"""WITH {E} SELECT aggregate_id, sequence, CASE WHEN event_type = 'JourneyClosed' THEN 'Complete' ELSE 'InProgress' END AS state,
  last_value(CASE WHEN event_type = 'StepProgressed' THEN 'step_' || (k % 7) END IGNORE NULLS) OVER p AS current_step, last_value(CASE WHEN event_type = 'WorkflowEvaluated' THEN ph END IGNORE NULLS) OVER p AS phase,
  ts AS valid_from, lead(ts) OVER (PARTITION BY aggregate_id ORDER BY sequence) AS valid_to FROM e WINDOW p AS (PARTITION BY aggregate_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)""",
    "F12_upcast_legacy_events": f"""WITH {W}, u AS (SELECT path, CASE WHEN del THEN 'delete' ELSE 'set' END AS op FROM w WHERE NOT (del AND path LIKE '/profile/tags/%')
  UNION ALL SELECT '/profile', 'object' FROM e WHERE event_type = 'JourneyModified' UNION ALL SELECT '/profile/tags', CASE WHEN k % 7 = 0 THEN 'object' ELSE 'array' END FROM e WHERE event_type = 'JourneyModified')
  SELECT path, op, count(*) AS n FROM u GROUP BY ALL""",
    "R4_decision_table_first": f"WITH {T} SELECT cabin, multiplier, discount, count(*) AS n FROM t1 GROUP BY ALL",
    "R6_switch_node": f"WITH {X} SELECT error_type, branch, count(*) AS n FROM y GROUP BY ALL",
    "R9_journey_phase": f"""WITH {S}, ph AS (SELECT aggregate_id, {PHASE} AS r FROM sb) SELECT aggregate_id, ['booking_confirmed','collecting_search','selecting_outbound','selecting_return','collecting_passengers','collecting_payment'][r] AS phase,
  ['booking_confirmation','','flight_search_results','return_flight_selection,flight_search_results','passenger_details','seat_selection,passenger_details'][r] AS actions FROM ph""",
    "R8_rule_cells": f"WITH {S}, ph AS (SELECT aggregate_id, {PHASE} AS r FROM sb) SELECT aggregate_id, {PHASES} FROM ph",
    "R3_expression_node": f"""WITH {S} SELECT aggregate_id, origin IS NOT NULL AND destination IS NOT NULL AS has_search, outbound IS NOT NULL AS has_outbound, return_flight IS NOT NULL AS has_return, trip_type = 'round-trip' AS round_trip,
  payment_status = 'completed' AS payment_done, n_persons >= adults + children AND n_persons > 0 AND n_untyped = 0 AS pax_complete, CAST(adults + children AS INTEGER) AS n_required FROM sb""",
    "S8_load_rule_tables": _price("multiplier, discount, seasonal, surcharge, baggage_fees, round(tax_total, 2) AS tax_total, insurance_fee"),
    "R10_price_base": _price("multiplier, discount"),
    "R11_price_season": _price("seasonal, surcharge"),
    "R12_fee_baggage": _price("baggage_fees"),
    "R13_fee_ancillary": _price("ancillary_fees"),
    "R14_fee_tax": _price("round(tax_total, 2) AS tax_total"),
    "R15_fee_insurance": _price("insurance_fee"),
    "R16_price_total": _price("CAST(round(CAST((fare0 * multiplier * seasonal - fare0 * multiplier * seasonal * discount + surcharge) * pax + baggage_fees + ancillary_fees + tax_total + insurance_fee AS DECIMAL(20, 6)), 2) AS DOUBLE) AS grand_total"),
    "R17_recover_validation": _recovery("validation"),
    "R18_recover_payment": _recovery("payment"),
    "R19_recover_availability": _recovery("availability"),
    "R20_recover_system": _recovery("system"),
    "R21_recover_business_rule": _recovery("business_rule"),
    "R22_error_response": f"""WITH {X}, q AS (SELECT *, CASE error_type WHEN 'validation' THEN 5 WHEN 'payment' THEN 3 WHEN 'availability' THEN 2 WHEN 'system' THEN 3 WHEN 'timeout' THEN 3 WHEN 'business_rule' THEN 1 ELSE 2 END AS mx,
  CASE error_type WHEN 'payment' THEN 30 WHEN 'availability' THEN 10 WHEN 'system' THEN 60 WHEN 'timeout' THEN 30 ELSE 15 END AS base FROM r)
  SELECT {KEY}, mx AS max_retries, retry < mx AS can_retry, CAST(floor(base * pow(1.5, retry)) AS BIGINT) AS delay_seconds, CASE WHEN branch = 'payment' THEN coalesce(CAST(extra AS INTEGER), 0) ELSE 0 END AS hold_minutes, coalesce(action, 'unknown') AS recovery_action FROM q""",
    "R23_step_transitions": f"""WITH {E}, st AS (SELECT 'step_' || (k % 7) AS to_step, lag('step_' || (k % 7)) OVER (PARTITION BY aggregate_id ORDER BY sequence) AS from_step FROM e WHERE event_type = 'StepProgressed')
  SELECT from_step, to_step, count(*) AS n FROM st WHERE to_step IS DISTINCT FROM from_step GROUP BY ALL""",
    "R24_phase_funnel": f"WITH {E}, {_scalars()} SELECT phase, count(*) AS n_journeys FROM sd GROUP BY 1",
    "R24_phase_gaps": f"""WITH {E}, d AS (SELECT ph AS phase, epoch_us(lead(ts) OVER (PARTITION BY aggregate_id ORDER BY sequence)) - epoch_us(ts) AS gap FROM e WHERE event_type = 'WorkflowEvaluated')
  SELECT phase, count(gap) AS n, round(avg(gap) / 1e6, 3) AS mean_seconds FROM d GROUP BY 1""",
    "P1_project_journey_view": f"""WITH {E}, {_scalars()},
  lm AS (SELECT aggregate_id, k, value AS v FROM e WHERE event_type = 'JourneyModified' QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence DESC) = 1),
  lc AS (SELECT aggregate_id, k, value AS v FROM e WHERE event_type = 'AttributesSet' AND src = 'click' QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence DESC) = 1),
  lp AS (SELECT aggregate_id, value AS v FROM e WHERE event_type = 'AttributesSet' AND src = 'purchase' QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence DESC) = 1)
  SELECT sd.aggregate_id, state, current_step, phase, actions, version, created_at, updated_at, '{{' || concat_ws(',',
    CASE WHEN lp.v IS NOT NULL OR lc.v IS NOT NULL THEN '"booking":{{' || concat_ws(',', '"last":{{"amount":' || {_number("lp.v")} || '}}', '"value":' || {_number("lc.v")}) || '}}' END,
    CASE WHEN lm.k IS NOT NULL THEN '"profile":{{"k":' || lm.k || ',"tags":' || CASE WHEN lm.k % 7 = 0 THEN '{{"x":' || lm.k || '}}' ELSE '[' || array_to_string([lm.k, lm.k + 1][1:lm.k % 3], ',') || ']' END
      || CASE WHEN lm.k % 10 <> 0 THEN ',"v":' || {_number("lm.v")} ELSE '' END || '}}' END,
    '"search":{{"k":' || lc.k || '}}') || '}}' AS shared_data
  FROM sd LEFT JOIN lm USING (aggregate_id) LEFT JOIN lc USING (aggregate_id) LEFT JOIN lp USING (aggregate_id)""",
    "P2_project_persons": f"WITH {PERSONS} SELECT aggregate_id, person_ref, subject_id, name, email, phone, forgotten FROM pe",
    "P3_project_workflow_history": f"""WITH {E} SELECT aggregate_id, sequence, 'a' || (k % 5) AS actions, ph AS phase, sequence = max(sequence) OVER (PARTITION BY aggregate_id) AS is_latest FROM e WHERE event_type = 'WorkflowEvaluated'""",
    "Q1_load_journey": f"""WITH {PERSONS} SELECT 'o42' AS aggregate_id, (SELECT max(v) FROM (SELECT 1 AS v UNION ALL SELECT sequence FROM cap WHERE aggregate_id = 'o42' UNION ALL SELECT sequence FROM att WHERE aggregate_id = 'o42'
    UNION ALL SELECT coalesce(m.m, -1) + 4 FROM orders LEFT JOIN m ON l_orderkey = o_orderkey WHERE o_orderkey = 42 AND o_orderstatus = 'F')) AS version,
  (SELECT count(*) FROM pe WHERE aggregate_id = 'o42') AS n_persons, (SELECT min(person_ref) FROM pe WHERE aggregate_id = 'o42') AS first_ref""",
    "Q2_load_all": f"""WITH {PERSONS}, g AS (SELECT aggregate_id, count(*) AS n, string_agg(subject_id, ',' ORDER BY person_ref) AS subjects FROM pe GROUP BY 1)
  SELECT 'o' || o_orderkey AS aggregate_id, CAST(CASE WHEN o_orderstatus = 'F' THEN coalesce(m.m, -1) + 4 WHEN m.m > 0 THEN m.m + 3 ELSE 2 END AS BIGINT) AS version, o_orderstatus = 'F' AS complete, coalesce(g.n, 0) AS n_persons, g.subjects
  FROM orders LEFT JOIN m ON l_orderkey = o_orderkey LEFT JOIN g ON g.aggregate_id = 'o' || o_orderkey""",
    "Q3_page_journeys": f"WITH {E}, {_scalars()} SELECT aggregate_id, created_at FROM s ORDER BY created_at DESC, aggregate_id LIMIT 50 OFFSET 50",
    "Q4_load_persons": f"WITH {PERSONS} SELECT aggregate_id, person_ref, subject_id, name, email, phone, forgotten FROM pe",
    "Q5_find_by_email": f"WITH {PERSONS} SELECT DISTINCT aggregate_id FROM pe WHERE NOT forgotten AND lower(email) IN (SELECT e FROM em)",
    "Q6_find_journeys_by_subject": f"WITH {P} SELECT DISTINCT subject_id, aggregate_id FROM cap WHERE subject_id IN (SELECT subject_id FROM er)",
    "Q7_find_subjects_by_email": f"WITH {P} SELECT subject_id FROM lk WHERE email_lower IN (SELECT e FROM em)",
    "Q8_maintain_subject_lookup": f"WITH {P} SELECT subject_id, email_lower FROM lk WHERE subject_id NOT IN (SELECT subject_id FROM er)",
    "Q9_delete_subject_lookup": f"WITH {P} SELECT subject_id, email_lower FROM lk WHERE subject_id NOT IN (SELECT subject_id FROM er)",
    "Q10_subject_journey_map": f"WITH {P} SELECT subject_id, aggregate_id FROM cap UNION SELECT subject_id, aggregate_id FROM pa",
    "Q11_kek_usage": f"WITH {P} SELECT kek_id, count(*) AS n FROM ks GROUP BY 1",
    "Q12_unknown_kek_ids": f"WITH {P} SELECT DISTINCT kek_id FROM ks WHERE kek_id = 'v1'",
    "Q13_inspect_raw_events": "SELECT 'o42' AS aggregate_id, 3 + row_number() OVER (ORDER BY l_linenumber, l_partkey, l_suppkey) AS sequence, l_extendedprice AS price, CAST(NULL AS VARCHAR) AS passport_lead FROM lineitem WHERE l_orderkey = 42",
    "Q14_events_by_type": f"WITH {E} SELECT event_type, event_version, count(*) AS n FROM e GROUP BY ALL",
    "Q15_erasure_survival_report": f"WITH {P} SELECT subject_id, CASE WHEN subject_id IN (SELECT subject_id FROM er) THEN 0 ELSE count(*) END AS n_kept, CASE WHEN subject_id IN (SELECT subject_id FROM er) THEN count(*) ELSE 0 END AS n_redacted FROM pa GROUP BY subject_id",
    "C1_extract_partitions": f"WITH {P} SELECT subject_id, label, count(*) AS n FROM pa GROUP BY ALL",
    "C3_encrypt_events": f"""WITH {P}, one AS (SELECT aggregate_id, sequence, 'PersonCaptured' AS event_type, 0 AS n, subject_id, 'default' AS label, length('{{"name":"' || name || '","email":"' || email || '","phone":' || coalesce('"' || phone || '"', 'null') || '}}') + 16 AS b FROM cap
  UNION ALL SELECT att.aggregate_id, att.sequence, 'AttributesSet', CASE label WHEN 'lead' THEN 0 ELSE 1 END, cap.subject_id, label, length('{{"' || path || '":"' || value || '"}}') + 16 FROM att JOIN cap ON cap.aggregate_id = att.aggregate_id AND cap.person_ref = att.label),
  pr AS (SELECT 'o' || l_orderkey AS aggregate_id, n + 3 AS sequence, l_extendedprice AS price FROM l)
  SELECT aggregate_id, CAST(sequence AS BIGINT) AS sequence, event_type, string_agg(subject_id, ',' ORDER BY n) AS subjects, string_agg(label, ',' ORDER BY n) AS labels, CAST(sum(b) AS BIGINT) AS n_bytes, max(CASE WHEN event_type = 'AttributesSet' THEN price END) AS price
  FROM one LEFT JOIN pr USING (aggregate_id, sequence) GROUP BY ALL""",
    "C5_reconstruct_events": _payloads("er"),
    "S4_scan_decrypted_log": _payloads("nobody"),
    "C4_decrypt_events": f"WITH {P} SELECT aggregate_id, sequence, label, path, value FROM att",
    "C6_redact_events": f"""WITH {P} SELECT aggregate_id, CAST(sequence AS BIGINT) AS sequence, cap.subject_id, CASE WHEN er.subject_id IS NULL THEN name ELSE '[redacted]' END AS name,
  CASE WHEN er.subject_id IS NULL THEN email ELSE '[redacted]' END AS email, CASE WHEN er.subject_id IS NULL THEN phone END AS phone, CASE WHEN er.subject_id IS NULL THEN 'decrypted' ELSE 'redacted' END AS status
  FROM cap LEFT JOIN er ON er.subject_id = cap.subject_id""",
    "C8_read_legacy_ciphertext": f"""WITH {P} SELECT aggregate_id, CAST(sequence AS BIGINT) AS sequence, cap.subject_id, CASE WHEN er.subject_id IS NULL THEN name END AS name, CASE WHEN er.subject_id IS NULL THEN 'decrypted' ELSE 'redacted' END AS status
  FROM cap LEFT JOIN er ON er.subject_id = cap.subject_id""",
    "C18_forgotten_events": f"""WITH {P}, hit AS (SELECT DISTINCT aggregate_id, subject_id FROM cap WHERE subject_id IN (SELECT subject_id FROM er)), mx AS (SELECT 'o' || o_orderkey AS aggregate_id, greatest(3, coalesce(m + 3, 2), CASE WHEN o_orderstatus = 'F' THEN coalesce(m, -1) + 4 ELSE 0 END, CASE WHEN m IS NULL THEN 2 ELSE 3 END) AS last, m FROM orders LEFT JOIN m ON l_orderkey = o_orderkey)
  SELECT hit.aggregate_id, hit.subject_id, CAST(CASE WHEN mx.m IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM orders WHERE 'o' || o_orderkey = hit.aggregate_id AND o_orderstatus = 'F') THEN 3 ELSE 2 END ELSE mx.last END + row_number() OVER (PARTITION BY hit.aggregate_id ORDER BY hit.subject_id) AS BIGINT) AS sequence FROM hit JOIN mx USING (aggregate_id)""",
    "J9_normalize_attributes_command": f"""WITH {S}, {FLAT} SELECT aggregate_id, path, value FROM fl WHERE CAST(substr(aggregate_id, 2) AS BIGINT) % 2 = 0
  UNION ALL SELECT aggregate_id, '/booking/paymentStatus', payment_status FROM sb WHERE k % 2 = 1""",
    "V3_validate_step_rules": f"""WITH {S}, v AS (SELECT aggregate_id, k % 6 AS st, origin, destination, adults + children AS pax, trip_type, adults = 2 AS returns, outbound, return_flight, k, n_persons FROM sb),
f AS (SELECT aggregate_id, st, CASE st WHEN 0 THEN CAST(coalesce(length(origin) <> 3, true) AS INT) + CAST(length(destination) <> 3 AS INT) + CAST(pax <= 0 OR pax > 9 AS INT) + CAST(trip_type = 'round-trip' AND NOT returns AS INT)
  WHEN 1 THEN CAST(outbound IS NULL AS INT) WHEN 2 THEN CAST(return_flight IS NULL AS INT)
  WHEN 3 THEN CAST(n_persons = 0 OR k % 4 = 3 AS INT) + CAST(n_persons > 0 AND k % 5 = 0 AS INT) + CAST(n_persons > 0 AND k % 11 = 0 AS INT)
  WHEN 4 THEN CAST(k % 3 = 2 AS INT) + CAST(k % 3 = 0 AND k % 2 = 0 AS INT) + CAST(k % 3 = 0 AND k % 5 = 1 AS INT) + CAST(k % 7 = 0 AS INT) ELSE CAST(k % 4 = 1 AS INT) END AS n FROM v)
SELECT aggregate_id, n = 0 AS is_valid, n AS n_errors, ['origin,destination,departureDate,passengers,returnDate', 'selectedOutboundFlight', 'selectedReturnFlight', 'passengers,passengerNames,passengerAges', 'paymentMethod,cardNumber,expiryDate,billingAddress', 'termsAccepted'][st + 1] AS validated FROM f""",
    "F6_fold_person_details": f"""WITH {ADMIT}, w AS (
  SELECT aggregate_id, person_ref, sequence, '/note/k' AS path, CAST(k AS VARCHAR) AS value, false AS del FROM a WHERE command = 'CapturePersonDetails' AND error IS NULL
  UNION ALL SELECT aggregate_id, person_ref, sequence, '/seat', CAST(k % 5 AS VARCHAR), k % 4 = 0 FROM a WHERE command = 'CapturePersonDetails' AND error IS NULL
  UNION ALL SELECT aggregate_id, person_ref, sequence, '/passportNumber', CAST(k AS VARCHAR), false FROM a WHERE command = 'SetAttributes' AND error IS NULL AND path LIKE '/persons/%')
  SELECT aggregate_id, person_ref, path, value FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id, person_ref, path ORDER BY sequence DESC) AS r FROM w) WHERE r = 1 AND NOT del""",
    # A whole search is good or bad by itself; anything else about it needs an accepted one before.
    "K5_admit_data": f"""WITH {ADMIT}, w AS (SELECT aggregate_id, sequence, command, k, CASE WHEN NOT started THEN 'NotFound' WHEN completed THEN 'AlreadyCompleted' END AS guard,
    CASE WHEN command = 'Capture' THEN CASE WHEN k % 3 = 0 THEN 'data' ELSE 'other' END ELSE CASE k % 9 WHEN 0 THEN 'search' WHEN 1 THEN 'status' WHEN 2 THEN 'empty' ELSE 'adults' END END AS what
    FROM a WHERE command IN ('Capture', 'SetAttributes')),
  f AS (SELECT *, coalesce(min(sequence) FILTER (WHERE guard IS NULL AND what IN ('data', 'search') AND k % 4 > 0) OVER (PARTITION BY aggregate_id) < sequence, false) AS filled FROM w),
  r AS (SELECT *, CASE WHEN guard IS NOT NULL THEN '' WHEN what IN ('data', 'search') THEN CASE WHEN k % 4 = 0 THEN '/search/passengers/adults minimum' ELSE '' END
    WHEN what = 'status' THEN CASE WHEN k % 2 = 0 THEN '' ELSE '/booking/paymentStatus type' END WHEN what = 'other' THEN ''
    ELSE concat_ws(',', CASE WHEN NOT filled THEN '/search required:departureDate,/search required:destination,/search required:origin,/search required:tripType' END,
      CASE WHEN NOT filled AND what = 'empty' THEN '/search/passengers required:adults' END,
      CASE WHEN NOT filled THEN '/search/passengers required:children' END, CASE WHEN what = 'adults' AND k % 5 = 0 THEN '/search/passengers/adults minimum' END) END AS found FROM f)
  SELECT aggregate_id, sequence, command, coalesce(guard, CASE WHEN found <> '' THEN 'InvalidData' END) AS error, nullif(found, '') AS reasons FROM r""",
    "K5_admit_change_sets": f"""WITH {ADMIT}, x AS (SELECT aggregate_id, sequence, k, path FROM a WHERE command = 'SetAttributes' AND path IS NOT NULL
    UNION ALL SELECT aggregate_id, sequence, k, '/persons/p' || ((k + 1) % 4) || '/lastName' FROM a WHERE command = 'SetAttributes' AND k % 3 = 0
    UNION ALL SELECT aggregate_id, sequence, k, '/other/x' FROM a WHERE command = 'SetAttributes' AND k % 7 = 0),
  y AS (SELECT x.*, {CLASS.replace("path", "x.path")} AS class, b.b0 FROM x LEFT JOIN b ON b.aggregate_id = x.aggregate_id AND b.person_ref = split_part(x.path, '/', 3)),
  z AS (SELECT aggregate_id, sequence, string_agg(path, ',' ORDER BY path) FILTER (WHERE class = 'unknown') AS unknown_paths, arg_min(split_part(path, '/', 3), path) FILTER (WHERE class = 'secret' AND (b0 IS NULL OR b0 >= sequence)) AS unbound_ref FROM y GROUP BY ALL)
  SELECT a.aggregate_id, a.sequence, CASE WHEN NOT started THEN 'NotFound' WHEN completed THEN 'AlreadyCompleted' WHEN z.sequence IS NULL THEN 'InvalidData' WHEN unknown_paths IS NOT NULL THEN 'UnknownAttributePath' WHEN unbound_ref IS NOT NULL THEN 'PersonNotFound' END AS error,
    CASE WHEN started AND NOT completed THEN unknown_paths END AS unknown_paths, CASE WHEN started AND NOT completed AND unknown_paths IS NULL THEN unbound_ref END AS unbound_ref FROM a LEFT JOIN z USING (aggregate_id, sequence) WHERE command = 'SetAttributes'""",
    "C9_audit_ciphertext_integrity": f"WITH {P} SELECT CASE WHEN label = 'agent' THEN 'failed' ELSE 'decrypted' END AS status, count(*) AS n FROM pa GROUP BY 1",
    "C11_ensure_keys": f"WITH {P} SELECT DISTINCT subject_id FROM pa WHERE subject_id IN (SELECT subject_id FROM er)",
    "C13_unwrap_keys": f"WITH {P} SELECT kek_id, CASE WHEN kek_id = 'v2' THEN 'unwrapped' ELSE 'unknown_version' END AS status, count(*) AS n FROM ks GROUP BY ALL",
    "C14_list_stale_keys": f"WITH {P} SELECT subject_id, kek_id FROM ks WHERE kek_id <> 'v2'",
    "C15_rewrap_keys": f"WITH {P} SELECT subject_id, 'v3' AS kek_id, sha256(subject_id) AS data_key FROM ks",
    "C16_rewrap_cas": f"WITH {P} SELECT 'v2' AS kek_id, count(*) AS n FROM ks WHERE subject_id NOT IN (SELECT subject_id FROM er)",
    "C17_rollback_rotation": f"WITH {P} SELECT kek_id AS old_kek_id, 'v1' AS kek_id, CASE WHEN kek_id = 'v1' THEN 'already_current' ELSE 'rewrapped' END AS status, count(*) AS n FROM ks GROUP BY ALL",
    "C18_shred_subjects": f"WITH {P} SELECT subject_id, kek_id FROM ks WHERE subject_id NOT IN (SELECT subject_id FROM er)",
    "C19_shred_by_email": f"WITH {P} SELECT kek_id, count(*) AS n FROM ks WHERE subject_id NOT IN (SELECT subject_id FROM lk WHERE email_lower IN (SELECT e FROM em)) GROUP BY 1",
    "C20_partial_shred_read": f"WITH {P} SELECT aggregate_id, sequence, label, CASE WHEN subject_id IN (SELECT subject_id FROM er) THEN 'redacted' ELSE 'decrypted' END AS status FROM pa WHERE label <> 'default'",
    "C21_derive_subject_id": f"""WITH x AS (SELECT c_custkey, sha256(from_hex('{_pad(0x5C)}') || from_hex(sha256(from_hex('{_pad(0x36)}') || encode('user' || (c_custkey % 1000) || '@mail.example.com')))) AS h FROM customer)
  SELECT c_custkey, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], ('89ab')[(instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1] || h[18:20], h[21:32]) AS id FROM x""",
    "C22_subject_linkage_report": f"WITH {P} SELECT lower(email) AS email, count(DISTINCT subject_id) AS n_subjects FROM cap GROUP BY 1 HAVING count(DISTINCT subject_id) > 1",
    "C22_subject_addresses": f"WITH {ADMIT} SELECT subject_id, count(DISTINCT k) AS n_emails FROM a WHERE error IS NULL AND command = 'CapturePerson' GROUP BY 1 HAVING count(DISTINCT k) > 1",
    "W7_backfill_subject_lookup": f"WITH {P} SELECT subject_id, email_lower FROM lk WHERE subject_id LIKE 'c%'",
    "W8_backfill_kek_id": f"WITH {P} SELECT CASE WHEN kek_id = 'v2' THEN 'v2' ELSE 'legacy:v1' END AS kek_id, count(*) AS n FROM ks GROUP BY 1",
}

#: Whole journeys are the rows of P1 with their persons as JSON text.
ORACLE_SQL["Q2_load_journeys"] = f"""SELECT p1.*, coalesce(ps.persons, '[]') AS persons FROM ({ORACLE_SQL["P1_project_journey_view"]}) p1 LEFT JOIN (WITH {ADMIT},
  ok AS (SELECT * FROM a WHERE error IS NULL AND command = 'CapturePerson'), gone AS (SELECT DISTINCT aggregate_id, 's' || k AS subject_id FROM a WHERE error IS NULL AND command = 'Complete'),
  lost AS (SELECT aggregate_id, person_ref, arg_min(subject_id, sequence) AS subject_id, arg_max(k, sequence) AS k FROM ok GROUP BY ALL),
  pj AS (SELECT lost.aggregate_id, person_ref, '{{"person_ref":"' || person_ref || '","subject_id":"' || lost.subject_id || '"' || CASE WHEN lost.subject_id LIKE '%3' THEN '' ELSE ',"name":"N' || k || '","email":"M' || k || '@x.org"' || CASE WHEN k % 2 = 0 THEN ',"phone":"+' || k || '"' ELSE '' END END
    || ',"forgotten":' || CASE WHEN gone.subject_id IS NULL THEN 'false' ELSE 'true' END || '}}' AS j FROM lost LEFT JOIN gone ON gone.aggregate_id = lost.aggregate_id AND gone.subject_id = lost.subject_id)
  SELECT aggregate_id, '[' || string_agg(j, ',' ORDER BY person_ref) || ']' AS persons FROM pj GROUP BY 1) ps USING (aggregate_id)"""

#: Erasure by address: what C18 appends for the subjects of these addresses, and what stays of keys and lookup.
ORACLE_SQL["C19_erase_by_email"] = f"""WITH {P}, wanted AS (SELECT subject_id FROM lk WHERE email_lower IN (SELECT e FROM em)), ev AS ({ORACLE_SQL["C18_forgotten_events"].replace("(SELECT subject_id FROM er)", "(SELECT subject_id FROM lk WHERE email_lower IN (SELECT e FROM em))")})
  SELECT 'keys' AS what, subject_id, CAST(NULL AS VARCHAR) AS aggregate_id, CAST(NULL AS BIGINT) AS sequence FROM ks WHERE subject_id NOT IN (SELECT subject_id FROM wanted)
  UNION ALL SELECT 'lookup', subject_id, NULL, NULL FROM lk WHERE subject_id NOT IN (SELECT subject_id FROM wanted) UNION ALL SELECT 'events', subject_id, aggregate_id, sequence FROM ev"""
