"""Decision tables as Catalyst expressions.

A table is a list of rules (condition in SQL, outputs); the first policy gives the outputs of the first rule that holds, the collect policy an array of those of
all that hold, in the order of the rules. Tables are data: another set of rules needs no code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .fold import patch_writes


@dataclass(frozen=True)
class Table:
    outputs: dict[str, str]  # name -> type
    rules: list[tuple[str, tuple[str, ...]]]  # condition, an SQL expression for each output

    def _struct(self, values: tuple[str, ...]) -> Column:
        return F.struct(*[F.expr(v).cast(kind).alias(name) for (name, kind), v in zip(self.outputs.items(), values)])

    def first(self) -> Column:
        """The outputs of the first rule that holds; null if none does."""
        out = F.lit(None).cast("struct<" + ",".join(f"{n}:{t}" for n, t in self.outputs.items()) + ">")
        for condition, values in reversed(self.rules):
            out = F.when(F.expr(condition), self._struct(values)).otherwise(out)
        return out

    def collect(self) -> Column:
        rows = F.array(*[F.when(F.expr(condition), self._struct(values)) for condition, values in self.rules])
        return F.filter(rows, lambda r: r.isNotNull())


def load(spec: dict) -> Table:
    """A table from its JSON form: {"outputs": {...}, "rules": [{"when": ..., "then": [...]}]}."""
    return Table(dict(spec["outputs"]), [(r.get("when") or "true", tuple(r["then"])) for r in spec["rules"]])


# The decision tables below.
PHASE = Table(
    {"phase": "string", "actions": "array<string>"},
    [
        ("payment_done", ("'booking_confirmed'", "array('booking_confirmation')")),
        ("not has_search", ("'collecting_search'", "array()")),
        ("has_search and not has_outbound", ("'selecting_outbound'", "array('flight_search_results')")),
        ("has_search and has_outbound and round_trip and not has_return", ("'selecting_return'", "array('return_flight_selection', 'flight_search_results')")),
        ("has_search and not pax_complete", ("'collecting_passengers'", "array('passenger_details')")),
        ("has_search and pax_complete", ("'collecting_payment'", "array('seat_selection', 'passenger_details')")),
    ],
)
BASE = Table(
    {"multiplier": "double", "discount": "double"},
    [
        ("cabin = 'first' and distance <= 2000", ("3.5", "0")),
        ("cabin = 'first' and distance > 2000", ("4.2", "0")),
        ("cabin = 'business' and distance <= 2000", ("2.1", "0")),
        ("cabin = 'business' and distance > 2000", ("2.8", "0")),
        ("cabin = 'premium-economy' and days_ahead > 21", ("1.4", "0.05")),
        ("cabin = 'premium-economy'", ("1.4", "0")),
        ("cabin = 'economy' and days_ahead > 14", ("1.0", "0.1")),
        ("cabin = 'economy'", ("1.0", "0")),
    ],
)
SEASON = Table(
    {"seasonal": "double", "surcharge": "double"},
    [
        ("month(departure_date) in (6, 7, 8, 12)", ("1.25", "0")),
        ("month(departure_date) in (4, 5, 9, 10)", ("1.1", "0")),
        ("month(departure_date) in (1, 2, 3, 11) and dayofweek(departure_date) in (1, 7)", ("0.9", "25")),
        ("true", ("0.9", "0")),
    ],
)
BAGGAGE = Table(
    {"kind": "string", "amount": "double"},
    [
        ("cabin in ('first', 'business') and bags <= 2 and weight <= 32", ("'baggage'", "0")),
        ("cabin = 'economy' and bags = 1 and weight <= 23 and distance <= 2000", ("'baggage'", "25")),
        ("cabin = 'economy' and bags = 1 and weight <= 23 and distance > 2000", ("'baggage'", "0")),
        ("cabin = 'economy' and bags = 2 and weight <= 23", ("'baggage'", "35")),
        ("weight > 23 and weight <= 32", ("'overweight'", "100")),
        ("weight > 32", ("'heavy_bag'", "200")),
    ],
)
ANCILLARY = Table(
    {"kind": "string", "amount": "double"},
    [
        ("seats and cabin = 'economy'", ("'Seat Selection'", "15")),
        ("premium_seat and cabin = 'economy'", ("'Premium Seat Selection'", "35")),
        ("priority and cabin in ('economy', 'premium-economy')", ("'Priority Boarding'", "20")),
        ("meals and cabin = 'economy' and distance > 1000", ("'Meal Selection'", "12")),
        ("wifi and distance > 500", ("'WiFi Access'", "8")),
        ("lounge and cabin in ('economy', 'premium-economy')", ("'Lounge Access'", "45")),
    ],
)
TAX = Table(
    {"kind": "string", "amount": "double"},
    [
        ("departure_country = 'US'", ("'Departure Tax'", "5.60")),
        ("departure_country = 'US'", ("'Security Fee'", "5.60")),
        ("departure_country = 'US' and arrival_country <> 'US'", ("'Immigration Fee'", "7.00")),
        ("departure_country <> 'US' and arrival_country = 'US'", ("'Arrival Tax'", "18.30")),
        ("departure_country = arrival_country", ("'Fuel Surcharge'", "15.00")),
        ("departure_country <> arrival_country", ("'Fuel Surcharge'", "45.00")),
    ],
)
INSURANCE = Table(
    {"fee": "double", "coverage": "double"},
    [
        ("plan is null", ("0", "0")),
        ("plan = 'basic' and trip_cost < 1000", ("25 * passengers", "5000")),
        ("plan = 'standard' and trip_cost between 1000 and 5000", ("45 * passengers", "10000")),
        ("plan = 'premium' and trip_cost > 5000", ("75 * passengers", "25000")),
    ],
)
_RECOVERY = {"action": "string", "next_step": "string", "extra": "string"}
RECOVER_VALIDATION = Table(
    _RECOVERY,
    [
        ("field in ('origin', 'destination') and current_step = 'search_criteria' and retry_count < 3", ("'suggest_airports'", "'search_criteria'", "'false'")),
        ("field in ('departureDate', 'returnDate') and current_step = 'search_criteria' and retry_count < 5", ("'show_date_picker'", "'search_criteria'", "'false'")),
        ("field = 'passengers' and current_step = 'search_criteria'", ("'redirect_group_booking'", "'group_booking'", "'false'")),
        ("field = 'passengers' and current_step = 'passenger_details' and retry_count < 3", ("'highlight_required_fields'", "'passenger_details'", "'false'")),
        ("retry_count >= 3", ("'offer_assistance'", "current_step", "'true'")),
    ],
)
RECOVER_PAYMENT = Table(
    _RECOVERY,
    [
        ("payment_code = 'INSUFFICIENT_FUNDS' and payment_method = 'credit_card' and retry_count < 2", ("'suggest_alternative_payment'", "'alternative_payment_methods'", "'15'")),
        ("payment_code = 'EXPIRED_CARD' and payment_method = 'credit_card'", ("'request_updated_card'", "'payment'", "'10'")),
        ("payment_code = 'FRAUD_SUSPECTED'", ("'require_verification'", "'payment'", "'30'")),
        ("payment_code = 'PROCESSOR_UNAVAILABLE' and retry_count < 3", ("'retry_after_delay'", "'payment'", "'20'")),
        ("retry_count >= 3", ("'escalate_to_support'", "'booking_summary'", "'1440'")),
    ],
)
RECOVER_AVAILABILITY = Table(
    _RECOVERY,
    [
        ("availability = 'FLIGHT_SOLD_OUT' and current_step in ('flight_search_results', 'outbound_flight_selection', 'return_flight_selection')", ("'show_alternative_flights'", "'flight_search_results'", "'true'")),
        ("availability = 'SEAT_UNAVAILABLE' and current_step = 'seat_selection'", ("'refresh_seat_map'", "'seat_selection'", "'true'")),
        ("availability = 'FARE_CHANGED' and current_step in ('booking_summary', 'payment')", ("'display_fare_change'", "'booking_summary'", "'false'")),
        ("availability = 'SCHEDULE_CHANGE'", ("'show_schedule_options'", "'flight_search_results'", "'true'")),
        ("availability = 'HOLD_EXPIRED'", ("'restart_booking_flow'", "'search_criteria'", "'false'")),
    ],
)
RECOVER_SYSTEM = Table(
    _RECOVERY,
    [
        ("system_type = 'DATABASE_CONNECTION' and severity in ('high', 'critical')", ("'queue_request_for_retry'", "current_step", "'high'")),
        ("system_type = 'EXTERNAL_API_TIMEOUT' and severity = 'medium' and service_status = 'degraded'", ("'retry_with_fallback'", "current_step", "'medium'")),
        ("system_type = 'CACHE_UNAVAILABLE' and severity = 'low' and service_status = 'operational'", ("'bypass_cache'", "current_step", "'low'")),
        ("severity = 'critical' and service_status = 'down'", ("'activate_maintenance_mode'", "'system_maintenance'", "'critical'")),
    ],
)
RECOVER_BUSINESS_RULE = Table(
    _RECOVERY,
    [
        ("violation = 'UNACCOMPANIED_MINOR_POLICY' and passenger_type = 'minor'", ("'show_minor_services'", "'unaccompanied_minor_services'", "'true'")),
        ("violation = 'INFANT_LAP_LIMIT' and passenger_type = 'infant'", ("'suggest_infant_seat'", "'passenger_details'", "'false'")),
        ("violation = 'VISA_REQUIREMENT'", ("'show_visa_requirements'", "'passenger_details'", "'true'")),
        ("violation = 'ADVANCE_BOOKING_LIMIT'", ("'suggest_alternative_dates'", "'search_criteria'", "'false'")),
        ("violation = 'COVID_RESTRICTIONS'", ("'show_health_requirements'", "'passenger_details'", "'true'")),
    ],
)
MAX_RETRIES = {"validation": 5, "payment": 3, "availability": 2, "system": 3, "timeout": 3, "business_rule": 1, "unknown": 2}
#: 15 where the base is 0 or not listed
BASE_DELAY = {"validation": 15, "payment": 30, "availability": 10, "system": 60, "timeout": 30, "business_rule": 15, "unknown": 15}


def phase_flags(bags: DataFrame) -> DataFrame:
    """The derived columns that PHASE tests; later ones use earlier ones."""
    return bags.withColumns(
        {
            "has_search": F.expr("origin is not null and destination is not null"),
            "has_outbound": F.col("outbound").isNotNull(),
            "has_return": F.col("return_flight").isNotNull(),
            "round_trip": F.col("trip_type") == "round-trip",
            "payment_done": F.col("payment_status") == "completed",
            "required": F.expr("coalesce(adults, 0) + coalesce(children, 0)"),
        }
    ).withColumn("pax_complete", F.expr("n_persons >= required and n_persons > 0 and n_untyped = 0"))


def journey_phase(bags: DataFrame) -> DataFrame:
    out = phase_flags(bags).withColumn("d", PHASE.first())
    return out.select(*bags.columns, F.col("d.phase").alias("phase"), F.col("d.actions").alias("actions"))


#: Where the inputs of PHASE stand in a journey's bag.
PHASE_PATHS = {
    "origin": "/search/origin", "destination": "/search/destination", "trip_type": "/search/tripType", "adults": "/search/passengers/adults", "children": "/search/passengers/children",
    "outbound": "/booking/selectedOutboundFlight", "return_flight": "/booking/selectedReturnFlight", "payment_status": "/booking/paymentStatus",
}


def evaluate(bag: DataFrame, pending: DataFrame, persons: DataFrame) -> DataFrame:
    """The phase of each journey with changes applied that aren't in its bag yet: bag and pending are (aggregate_id, path, value), persons has n_persons and n_untyped. A journey whose
    attributes are all deleted has a phase too."""
    writes = _layer(bag, 1).unionByName(_layer(pending, 2))
    return journey_phase(_inputs(writes, persons)).select("aggregate_id", "phase", "actions")


def evaluate_next_steps(bag: DataFrame, captured: DataFrame, persons: DataFrame, table: Table = PHASE) -> DataFrame:
    """The older envelope: captured (aggregate_id, step, data) has a step and a merge patch for each journey. The decision is made on the patched bag, with current_step as
    one more input of the table's conditions; journeys without a row in captured get none. A patch that isn't JSON changes nothing; outputs of table are returned."""
    here = captured.select("aggregate_id", F.col("step").alias("current_step"))
    before = _layer(bag.join(here, "aggregate_id", "left_semi"), 1).withColumn("arrays", F.lit(None).cast("array<string>"))
    patch = patch_writes(captured.select("aggregate_id", F.lit(2).alias("sequence"), "data").where("try_parse_json(data) is not null"), ["aggregate_id"])
    inputs = here.join(_inputs(before.unionByName(patch), persons), "aggregate_id", "left").fillna(0, ["adults", "children", "n_persons", "n_untyped"])
    return phase_flags(inputs).withColumn("d", table.first()).select("aggregate_id", "current_step", "d.*")


def _layer(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("aggregate_id", F.lit(n).alias("sequence"), F.lit(0).alias("part"), "path", "value", F.when(F.col("value").isNull(), "delete").otherwise("set").alias("op"))


def _inputs(writes: DataFrame, persons: DataFrame) -> DataFrame:
    """What PHASE tests, of the bag that stands after the writes."""
    wide = paths.last_values(writes, ["aggregate_id"], ["sequence", "part"], PHASE_PATHS)
    wide = wide.join(persons.select("aggregate_id", "n_persons", "n_untyped"), "aggregate_id", "left").fillna(0, ["n_persons", "n_untyped"])
    return wide.withColumns({"adults": F.col("adults").cast("int"), "children": F.col("children").cast("int")})


def total(fees: str) -> Column:
    return F.aggregate(F.col(fees), F.lit(0.0), lambda a, x: a + x["amount"])


def price(quotes: DataFrame) -> DataFrame:
    """All parts of the price of each quote."""
    q = quotes.withColumn("cabin", F.replace("cabin", F.lit("_"), F.lit("-"))).withColumn("days_ahead", F.datediff("departure_date", "as_of"))
    q = q.withColumns({"base": BASE.first(), "season": SEASON.first(), "baggage": BAGGAGE.collect(), "ancillary": ANCILLARY.collect(), "taxes": TAX.collect(), "insurance": INSURANCE.first()})
    q = q.withColumns({"multiplier": F.coalesce("base.multiplier", F.lit(1.0)), "discount": F.coalesce("base.discount", F.lit(0.0)), "insurance_fee": F.coalesce("insurance.fee", F.lit(0.0))})
    q = q.withColumn("adjusted", F.col("base_fare") * F.col("multiplier") * F.col("season.seasonal"))
    q = q.withColumn("fare", (F.col("adjusted") - F.col("adjusted") * F.col("discount") + F.col("season.surcharge")) * F.col("passengers"))
    q = q.withColumns({"baggage_fees": total("baggage"), "ancillary_fees": total("ancillary"), "tax_total": total("taxes")})
    whole = F.col("fare") + F.col("baggage_fees") + F.col("ancillary_fees") + F.col("tax_total") + F.col("insurance_fee")
    # half cents are rounded up as decimals: sums of doubles fall on either side of them
    return q.withColumn("grand_total", F.round(whole.cast("decimal(20,6)"), 2).cast("double"))


def route_error(errors: DataFrame) -> DataFrame:
    """The branch of each error and its recovery: one column for the branch, no physical split."""
    branch = F.expr("case when error_type in ('validation', 'payment', 'availability', 'business_rule') then error_type else 'system' end")
    e = errors.withColumn("branch", branch)
    recovery = (
        F.when(F.col("branch") == "validation", RECOVER_VALIDATION.first())
        .when(F.col("branch") == "payment", RECOVER_PAYMENT.first())
        .when(F.col("branch") == "availability", RECOVER_AVAILABILITY.first())
        .when(F.col("branch") == "business_rule", RECOVER_BUSINESS_RULE.first())
        .otherwise(RECOVER_SYSTEM.first())
    )
    return e.withColumn("recovery", recovery)


def error_response(errors: DataFrame, jitter: Column | None = None) -> DataFrame:
    """Whether and after how many seconds to retry, with defaults where no rule holds; jitter is seeded by the caller, 0 if not given."""
    pick = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("error_type"))
    e = route_error(errors).withColumns({"max_retries": F.coalesce(pick(MAX_RETRIES), F.lit(2)), "base_delay": F.coalesce(pick(BASE_DELAY), F.lit(15))})
    return e.withColumns(
        {
            "recovery_action": F.coalesce("recovery.action", F.lit("unknown")),
            "next_step": F.coalesce("recovery.next_step", F.lit("search_criteria")),
            "can_retry": F.col("retry_count") < F.col("max_retries"),
            "delay_seconds": F.floor(F.col("base_delay") * F.pow(F.lit(1.5), F.col("retry_count")) + (jitter if jitter is not None else F.lit(0.0))),
            "hold_minutes": F.when(F.col("branch") == "payment", F.coalesce(F.col("recovery.extra").cast("int"), F.lit(0))).otherwise(0),
        }
    )
