"""Registered queries: each runs an operator over whole tables and returns plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, trees
from ..operators import admit, classify, documents, fold, keys, pii, rules, validate, views
from ..operators import models as rule_models
from ..operators import stored
from ..sources import commands, samples
from ..sources import event_log as log
from . import models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MASTER = {"v1": "11" * 32, "v2": "22" * 32, "v3": "33" * 32}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _e(spark, d):
    return log.scan_event_log(samples.event_log(spark, d))


def _open_keys(spark, d):
    return keys.unwrap(samples.key_table(spark, d, MASTER), MASTER)


def _live_keys(spark, d):
    return keys.shred(_open_keys(spark, d), samples.erasure_requests(spark, d))


def _sealed(spark, d):
    return pii.encrypt(pii.extract_partitions(samples.personal_log(spark, d)), _open_keys(spark, d))


# sources


@query
def S1_scan_event_log(spark, d):
    return _e(spark, d).select("aggregate_id", "sequence", "event_type", "event_version", "timestamp")


@query
def S2_scan_aggregate(spark, d):
    return log.scan_aggregate(_e(spark, d), "u8").select("aggregate_id", "sequence", "event_type")


@query
def S3_tail_after(spark, d):
    e = _e(spark, d)
    snap = e.groupBy("aggregate_id").agg(F.expr("cast(floor(max(sequence) / 2) as bigint)").alias("last_sequence")).where("aggregate_id not like '%7'")
    return log.tail_after(e, snap).select("aggregate_id", "sequence", "event_type")


@query
def S3_tail_last(spark, d):
    return log.tail_last(_e(spark, d), 3).select("aggregate_id", "sequence", "event_type")


@query
def S4_scan_all_decrypted(spark, d):
    got = pii.decrypt(_sealed(spark, d), _open_keys(spark, d))
    return pii.persons_read(got).select("aggregate_id", "sequence", "subject_id", "name", "email", "phone")


@query
def S6_latest_snapshot(spark, d):
    e = _e(spark, d)
    last, bag = fold.snapshot(e.where("sequence <= 40"))
    return fold.resume(last, bag, e.where("sequence > 40")).select("aggregate_id", "path", F.round(F.col("value").cast("double"), 4).alias("value"))


@query
def S10_parse_event_variant(spark, d):
    p = log.parse_events(_e(spark, d))
    return p.select("aggregate_id", "sequence", "step", "to_step", "phase", F.array_join("actions", ",").alias("actions"), F.coalesce("is_completed", F.lit(False)).alias("is_completed"))


def _person_events(spark, d):
    """Captures, details and erasures of accepted commands as events in the log's envelope."""
    ok = admit.admit(samples.commands(spark, d), classify.BOOKING).where("error is null")
    kind = F.expr("case command when 'CapturePerson' then 'PersonCaptured' when 'CapturePersonDetails' then 'PersonDetailsUpdated' when 'Complete' then 'SubjectForgotten' end")
    payload = F.expr("""case command
        when 'CapturePerson' then to_json(struct(struct(person_ref, subject_id, concat('N', k) as name, concat('M', k, '@x.org') as email, case when k % 2 = 0 then concat('+', k) end as phone) as PersonCaptured))
        when 'CapturePersonDetails' then concat('{"PersonDetailsUpdated":{"person_ref":"', person_ref, '","subject_id":"', slot_subject, '","data":', case when k % 4 = 0 then 'null' else concat('{"seat":', k, '}') end, '}}')
        else to_json(struct(struct(concat('s', k) as subject_id) as SubjectForgotten)) end""")
    rows = ok.select(F.lit("journey").alias("aggregate_type"), "aggregate_id", "sequence", kind.alias("event_type"), F.lit("1.0").alias("event_version"), payload.alias("payload"), F.lit("2020-01-01").cast("timestamp").alias("timestamp"))
    return rows.where("event_type is not null")


@query
def S10_parse_person_events(spark, d):
    return log.parse_events(_person_events(spark, d)).select("aggregate_id", "sequence", "event_type", "person_ref", "subject_id", "name", "email", "phone", "data")


@query
def W2_check_append_conflicts(spark, d):
    e = _e(spark, d)
    batch = e.where("sequence between 40 and 45").unionByName(e.where("sequence = 44 and aggregate_id like '%5'"))
    return log.append_conflicts(batch, e.where("sequence <= 42")).select("aggregate_id", "sequence", "conflict")


@query
def W3_check_sequence_gaps(spark, d):
    e = _e(spark, d).where("event_type <> 'StepProgressed'")
    return log.sequence_gaps(e)


@query
def W6_audit_log(spark, d):
    return log.audit_feed(_e(spark, d).where("event_type = 'StepProgressed'"))


# documents


@query
def J1_flatten_json(spark, d):
    flat = paths.flatten(samples.booking_bags(spark, d), "doc", ["aggregate_id"])
    return flat.select("aggregate_id", "path", "value", "is_null")


@query
def J2_assign_all(spark, d):
    return fold.fold_bag(_e(spark, d).where("event_type = 'AttributesSet'")).select("aggregate_id", "path", F.round(F.col("value").cast("double"), 4).alias("value"))


@query
def J2_rehydrate_json(spark, d):
    nodes = paths.flatten_nodes(samples.booking_bags(spark, d), "doc", ["aggregate_id"])
    return trees.rehydrate(nodes, ["aggregate_id"])


def _positions(spark, d):
    return fold.resolved(samples.list_log(spark, d))


@query
def J2_array_positions(spark, d):
    """Appended, replaced and refused elements of one list a journey."""
    writes, errors = _positions(spark, d)
    docs = trees.rehydrate(paths.last_writes(writes, ["aggregate_id"], fold.ORDER, containers=True), ["aggregate_id"])
    failed = errors.groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("n_errors"), F.min_by("error", "sequence").alias("first_error"))
    return docs.join(failed, "aggregate_id", "left").select("aggregate_id", "document", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "first_error")


@query
def J3_merge_patch(spark, d):
    return fold.fold_bag(_e(spark, d).where("event_type = 'JourneyModified'")).select("aggregate_id", "path", F.round(F.col("value").cast("double"), 4).alias("value"))


@query
def J4_shallow_merge(spark, d):
    writes = fold.upcast(_e(spark, d).where("event_type = 'AttributesSet'"))
    return paths.shallow_merge(writes, ["aggregate_id"], ["sequence"]).select("aggregate_id", "path", F.round(F.col("value").cast("double"), 4).alias("value"))


@query
def J5_json_get(spark, d):
    e = _e(spark, d).where("event_type = 'StepProgressed'")
    return e.select("aggregate_id", "sequence", F.get_json_object("payload", "$.StepProgressed.to_step").alias("to_step"))


@query
def J6_json_array_contains(spark, d):
    arr = F.from_json(F.get_json_object("payload", "$.WorkflowEvaluated.suggested_actions"), "array<string>")
    return _e(spark, d).where("event_type = 'WorkflowEvaluated'").where(F.array_contains(arr, "a3")).select("aggregate_id", "sequence")


@query
def J7_pointer_tokens(spark, d):
    p = F.concat(F.lit("/part~1"), F.replace("p_name", F.lit(" "), F.lit("~0")), F.lit("/"), F.col("p_brand"))
    t = paths.tokens(p)
    return samples.read(spark, d, "part").select("p_partkey", F.size(t).alias("n"), t[0].alias("first"), (paths.from_tokens(t) == p).alias("round_trip"))


@query
def J8_pointer_strip_prefix(spark, d):
    c = samples.commands(spark, d).where("path is not null")
    prefix = F.concat(F.lit("/persons/"), F.coalesce("person_ref", F.lit("none")))
    return c.select("aggregate_id", "sequence", paths.strip_prefix(F.col("path"), prefix).alias("below"))


@query
def J9_normalize_attributes_command(spark, d):
    nested = samples.booking_bags(spark, d).select("aggregate_id", F.when(F.expr("cast(substr(aggregate_id, 2) as bigint) % 2 = 0"), F.col("doc")).otherwise(F.concat(F.lit('{"changes":{"/booking/paymentStatus":"'), "payment_status", F.lit('"}}'))).alias("body"))
    return paths.normalize_changes(nested, "body", ["aggregate_id"])


@query
def J10_typed_view_of_bag(spark, d):
    kind = "search struct<tripType:string,origin:string,destination:string,passengers:struct<adults:int,children:int>>, booking struct<paymentStatus:string>"
    t = samples.booking_bags(spark, d).select("aggregate_id", F.from_json("doc", kind).alias("t"))
    return t.select("aggregate_id", "t.search.tripType", "t.search.origin", "t.search.passengers.adults", "t.booking.paymentStatus")


@query
def J11_values_of_map(spark, d):
    m = F.from_json(F.get_json_object("doc", "$.booking"), "map<string,string>")
    return samples.booking_bags(spark, d).select("aggregate_id", F.array_join(F.array_sort(F.map_values(m)), ",").alias("vals"))


# classification


@query
def A1_classify_path(spark, d):
    c = samples.commands(spark, d).where("path is not null")
    return c.groupBy("path", classify.BOOKING.classify(F.col("path")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query
def A2_secret_subject_path(spark, d):
    c = samples.commands(spark, d).where("path is not null")
    return c.where(classify.BOOKING.classify(F.col("path")) == "secret").select("aggregate_id", "sequence", classify.subject_slot(F.col("path")).alias("slot"))


def _classified(spark, d):
    c = samples.commands(spark, d)
    changes = c.where("command = 'SetAttributes' and path is not null").select("aggregate_id", "sequence", "path", F.col("amount").cast("string").alias("value"))
    captures = c.where("command = 'CapturePerson'").select("aggregate_id", "person_ref", "subject_id", F.col("sequence").alias("captured_at"))
    return classify.classify_changes(changes, captures, classify.BOOKING)


@query
def A3_classify_changes(spark, d):
    return _classified(spark, d).select("aggregate_id", "sequence", "path", "bucket", "subject_id")


@query
def A4_reject_unknown_paths(spark, d):
    return classify.rejections(_classified(spark, d)).where("error = 'UnknownAttributePath'").select("aggregate_id", "sequence", "unknown_paths")


@query
def A5_reject_unbound_secrets(spark, d):
    return classify.rejections(_classified(spark, d)).where("error = 'PersonNotFound'").select("aggregate_id", "sequence", "unbound_ref")


@query
def A6_build_secret_partitions(spark, d):
    return classify.secret_partitions(_classified(spark, d)).select("aggregate_id", "sequence", "subject_id", "label")


@query
def A7_known_paths(spark, d):
    return classify.undeclared(samples.commands(spark, d).where("path is not null"), classify.BOOKING)


@query
def A8_pii_inventory(spark, d):
    return classify.inventory(samples.commands(spark, d).where("path is not null"), classify.BOOKING)


# validation


@query
def V1_validate_json_schema(spark, d):
    v = validate.validate(samples.booking_bags(spark, d), "doc", validate.BOOKING)
    return v.select("aggregate_id", "valid", F.array_join("errors", ";").alias("errors"))


def _steps(spark, d):
    """Documents with one step each, and what the rules of all steps look at."""
    b = samples.booking_bags(spark, d).withColumn("k", F.expr("cast(substr(aggregate_id, 2) as bigint)"))
    step = F.expr("element_at(array('search_criteria', 'outbound_flight_selection', 'return_flight_selection', 'passenger_details', 'payment', 'booking_summary'), cast(k % 6 as int) + 1)")
    person = """struct(case when k % 5 = 0 then 'A' else 'Ann' end as first_name, 'Lee' as last_name, case when k % 11 = 0 then date'1850-01-01' else date'1980-01-01' end as birth, case when k % 4 <> 3 then 'P1' end as document)"""
    return b.withColumns(
        {
            "step": step, "passengers": F.expr("adults + children"), "return_date": F.expr("case when adults = 2 then date_add(departure_date, 7) end"),
            "details": F.expr(f"case when n_persons > 0 then array_repeat({person}, n_persons) end"), "payment_type": F.expr("element_at(array('credit_card', 'paypal', null), cast(k % 3 as int) + 1)"),
            "card_number": F.expr("case when k % 2 = 0 then '4111' else '4111111111111111' end"), "expiry": F.expr("case when k % 5 = 1 then '1990-01' else '2090-01' end"),
            "street": F.expr("case when k % 7 <> 0 then 'Main' end"), "city": F.lit("X"), "country": F.lit("Y"), "terms_accepted": F.expr("k % 4 <> 1"),
        }
    )


@query
def V3_validate_step_rules(spark, d):
    v = validate.validate_steps(_steps(spark, d))
    return v.select("aggregate_id", "is_valid", F.size("failures").alias("n_errors"), F.array_join("validated", ",").alias("validated"))


@query
def V4_check_state_domain(spark, d):
    s = fold.fold_scalars(_e(spark, d))
    return s.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("state").isin("InProgress", "Complete") | (F.col("version") < 0)).alias("n_violations"))


# admission


def _admitted(spark, d):
    return admit.admit(samples.commands(spark, d), classify.BOOKING)


def _verdict(command):
    def run(spark, d):
        return _admitted(spark, d).where(F.col("command") == command).select("aggregate_id", "sequence", "error")

    return run


for _name, _command in {"K1_admit_start": "Start", "K2_admit_capture_person": "CapturePerson", "K3_admit_capture_details": "CapturePersonDetails", "K4_admit_capture": "Capture", "K5_admit_set_attributes": "SetAttributes", "K6_admit_complete": "Complete"}.items():
    QUERIES[_name] = _verdict(_command)


@query
def K5_admit_change_sets(spark, d):
    c = samples.commands(spark, d)
    extra = F.expr("""filter(array(path, case when k % 3 = 0 then concat('/persons/p', (k + 1) % 4, '/lastName') end, case when k % 7 = 0 then '/other/x' end), p -> p is not null)""")
    changes = F.when(F.col("command") == "SetAttributes", F.transform(extra, lambda p: F.struct(p.alias("path"), F.col("amount").cast("string").alias("value"))))
    return admit.admit_change_sets(c.withColumn("changes", changes), classify.BOOKING).select("aggregate_id", "sequence", "error", "unknown_paths", "unbound_ref")


def _with_data(spark, d):
    """Commands whose changes and data are of three kinds: a whole search, its number of adults, a status of payment."""
    c = samples.commands(spark, d)
    search = """concat('{"tripType":"one-way","origin":"AMS","destination":"JFK","departureDate":"2030-01-01","passengers":{"adults":', k % 4 - 1, ',"children":0}}')"""
    change = F.expr(f"""case k % 9 when 0 then struct('/search' as path, {search} as value) when 1 then struct('/booking/paymentStatus' as path, if(k % 2 = 0, '"paid"', '7') as value)
        when 2 then struct('/search/passengers/' as path, 'null' as value) else struct('/search/passengers/adults' as path, cast(k % 5 - 1 as string) as value) end""")
    data = F.expr(f"""case when k % 3 = 0 then concat('{{"search":', {search}, '}}') else concat('{{"booking":{{"paymentStatus":', if(k % 2 = 0, '"open"', 'null'), '}}}}') end""")
    return c.withColumn("changes", F.when(F.col("command") == "SetAttributes", F.array(change))).withColumn("data", F.when(F.col("command") == "Capture", data))


@query
def K5_admit_data(spark, d):
    done = admit.admit_data(_with_data(spark, d), classify.BOOKING, validate.BOOKING)
    return done.where("command in ('Capture', 'SetAttributes')").select("aggregate_id", "sequence", "command", "error", F.array_join("reasons", ",").alias("reasons"))


@query
def K7_admit_forget_subject(spark, d):
    bound = pii.slots(samples.personal_log(spark, d)).withColumn("forgotten", F.lit(False))
    return admit.forget_events(samples.erasure_requests(spark, d), bound)


def _forgetting(spark, d):
    """The commands, of which some that capture details are erasures instead."""
    c = samples.commands(spark, d)
    erases = (F.col("command") == "CapturePersonDetails") & (F.col("k") % 2 == 0)
    subject = F.expr("concat('s', cast(substring(aggregate_id, 2) as bigint) + k % 4)")
    return c.withColumn("e", erases).withColumns({"command": F.when(F.col("e"), "ForgetSubject").otherwise(F.col("command")), "subject_id": F.when(F.col("e"), subject).otherwise(F.col("subject_id")), "person_ref": F.when(~F.col("e"), F.col("person_ref"))}).drop("e")


@query
def K7_forget_in_sequence(spark, d):
    a = admit.admit(_forgetting(spark, d), classify.BOOKING)
    return a.where("command = 'ForgetSubject'").select("aggregate_id", "sequence", "subject_id", "error", "forgets")


@query
def K8_emitted_events(spark, d):
    return admit.emitted(_admitted(spark, d)).groupBy("aggregate_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def K10_error_summary(spark, d):
    return admit.error_summary(_admitted(spark, d))


# folds


def _bag_columns(e):
    total = F.round(F.sum(F.round(F.col("value").cast("double"), 4)), 2).alias("bag_total")
    return fold.fold_bag(e).groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("bag_size"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("bag_paths"), total)


@query
def F1_replay_state(spark, d):
    e = _e(spark, d)
    v = fold.fold_scalars(e).join(_bag_columns(e), "aggregate_id", "left").withColumn("bag_size", F.coalesce("bag_size", F.lit(0)))
    return v.select("aggregate_id", "state", "current_step", "phase", F.array_join("actions", ",").alias("actions"), "version", "bag_size", F.coalesce("bag_paths", F.lit("")).alias("bag_paths"), "bag_total")


@query
def F3_fold_bag(spark, d):
    return fold.fold_bag(_e(spark, d)).select("aggregate_id", "path", F.round(F.col("value").cast("double"), 4).alias("value"))


@query
def F5_fold_person_captured(spark, d):
    return views.persons(samples.personal_log(spark, d), _open_keys(spark, d)).select("aggregate_id", "person_ref", "subject_id", "name", "email")


@query
def F6_fold_person_details(spark, d):
    ok = admit.admit(samples.commands(spark, d), classify.BOOKING).where("error is null")
    data = F.expr("""concat('{"note":{"k":', k, '},"seat":', case when k % 4 = 0 then 'null' else cast(k % 5 as string) end, '}')""")
    updates = ok.where("command = 'CapturePersonDetails'").select("aggregate_id", "person_ref", "sequence", data.alias("data"))
    secret = ok.where("command = 'SetAttributes' and path like '/persons/%'").select("aggregate_id", "person_ref", "sequence", "path", F.col("k").cast("string").alias("value"))
    return fold.fold_details(updates, secret, ok.where("command = 'CapturePerson'")).select("aggregate_id", "person_ref", "path", "value")


@query
def F7_fold_workflow(spark, d):
    return fold.fold_scalars(_e(spark, d)).select("aggregate_id", "phase", F.array_join("actions", ",").alias("actions"))


@query
def F8_fold_step(spark, d):
    return fold.fold_scalars(_e(spark, d)).select("aggregate_id", "current_step")


@query
def F9_fold_completed(spark, d):
    return fold.fold_scalars(_e(spark, d)).select("aggregate_id", "state", "started")


@query
def F10_replay_as_of(spark, d):
    e = _e(spark, d)
    points = e.groupBy("aggregate_id").agg(F.expr("cast(floor(max(sequence) * 2 / 3) as bigint)").alias("upto"))
    return views.journeys(fold.as_of(e, points)).select("aggregate_id", "state", "current_step", "phase", "version", "bag_size")


@query
def F11_state_history(spark, d):
    return fold.history(_e(spark, d))


@query
def F12_upcast_legacy_events(spark, d):
    return fold.upcast(_e(spark, d)).groupBy("path", "op").agg(F.count(F.lit(1)).alias("n"))


# rules


def _pending(spark, d):
    """Journeys without an origin get one, those whose number ends in 3 lose their outbound flight."""
    b = samples.booking_bags(spark, d)
    origin = b.where("origin is null").select("aggregate_id", F.lit("/search/origin").alias("path"), F.lit("NEW").alias("value"))
    return origin.unionByName(b.where("aggregate_id like '%3'").select("aggregate_id", F.lit("/booking/selectedOutboundFlight").alias("path"), F.lit(None).cast("string").alias("value")))


@query
def R1_evaluate_attributes(spark, d):
    b = samples.booking_bags(spark, d)
    bag = paths.flatten(b, "doc", ["aggregate_id"]).drop("is_null")
    return rules.evaluate(bag, _pending(spark, d), b).select("aggregate_id", "phase", F.array_join("actions", ",").alias("actions"))


@query
def R2_evaluate_next_steps(spark, d):
    b = samples.booking_bags(spark, d)
    bag = paths.flatten(b, "doc", ["aggregate_id"]).drop("is_null")
    outbound = F.when(F.col("aggregate_id").like("%3"), '"booking":{"selectedOutboundFlight":null}')
    origin = F.when(F.col("origin").isNull(), '"search":{"origin":"NEW"}')
    data = F.concat(F.lit("{"), F.concat_ws(",", origin, outbound), F.lit("}"))
    got = rules.evaluate_next_steps(bag, b.select("aggregate_id", F.concat(F.lit("step_"), "n_persons").alias("step"), data.alias("data")), b)
    return got.select("aggregate_id", "current_step", "phase", F.array_join("actions", ",").alias("actions"))


@query
def V2_validate_after_merge(spark, d):
    change = F.struct(F.lit("/search/origin").alias("path"), F.concat(F.lit('"'), F.coalesce("origin", F.lit("NEW")), F.lit('"')).alias("value"))
    merged = documents.assign_changes(samples.booking_bags(spark, d).withColumn("changes", F.array(change)), "doc", "changes")
    return validate.validate(merged, "merged", validate.BOOKING).select("aggregate_id", F.get_json_object("merged", "$.search.origin").alias("origin"), "valid")


@query
def S9_command_source(spark, d):
    c = samples.commands(spark, d)
    body = F.when(F.col("command") == "Start", "").otherwise(F.to_json(F.create_map("command", F.struct("person_ref", "subject_id", "step"))))
    none = F.lit(None).cast("string")
    rows = commands.parse_commands(c.select("aggregate_id", "sequence", body.alias("body"), none.alias("time"), F.lit("/journeys").alias("uri"), none.alias("user_agent")))
    return rows.select("aggregate_id", "sequence", "command", F.get_json_object("arguments", "$.step").alias("step"), F.element_at("metadata", "uri").alias("uri"))


@query
def R4_decision_table_first(spark, d):
    q = rules.price(samples.quotes(spark, d))
    return q.groupBy("cabin", "multiplier", "discount").agg(F.count(F.lit(1)).alias("n"))


@query
def R5_decision_table_collect(spark, d):
    q = rules.price(samples.quotes(spark, d))
    return q.select(F.explode("ancillary").alias("x")).groupBy("x.kind").agg(F.count(F.lit(1)).alias("n"), F.sum("x.amount").alias("total"))


@query
def R6_switch_node(spark, d):
    return rules.route_error(samples.errors(spark, d)).groupBy("error_type", "branch").agg(F.count(F.lit(1)).alias("n"))


@query
def R9_journey_phase(spark, d):
    p = rules.journey_phase(samples.booking_bags(spark, d))
    return p.select("aggregate_id", "phase", F.array_join("actions", ",").alias("actions"))


def _phase_rows(spark, d):
    """Booking documents as nested columns, the persons as a map by reference, with the columns of the model's expression nodes."""
    b = samples.booking_bags(spark, d).selectExpr(
        "aggregate_id", "struct(origin, destination, trip_type as tripType, struct(adults, children) as passengers) as search", "struct(outbound as selectedOutboundFlight, return_flight as selectedReturnFlight, payment_status as paymentStatus) as booking",
        "case when n_persons > 0 then map_from_entries(transform(sequence(1, n_persons), i -> struct(concat('p', i) as ref, struct(if(i > n_untyped, 'adult', null) as passengerType) as person))) end as persons",
    )
    for node in rule_models.load_model(models.PHASE).values():
        b = rule_models.evaluate(b, node)
    return b


@query
def R3_expression_node(spark, d):
    c = _phase_rows(spark, d)
    return c.selectExpr("aggregate_id", "computed.hasSearch as has_search", "computed.hasOutbound as has_outbound", "computed.hasReturn as has_return", "computed.isRoundTrip as round_trip", "computed.paymentDone as payment_done", "computed.passengersComplete as pax_complete", "cast(passenger_counts.required as int) as n_required")


@query
def R8_rule_cells(spark, d):
    return _phase_rows(spark, d).select("aggregate_id", "decision.phase", F.array_join("decision.actions", ",").alias("actions"))


@query
def S8_load_rule_tables(spark, d):
    q = samples.quotes(spark, d).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cabin as cabinClass", "distance", "cast(departure_date as string) as departureDate", "as_of", "struct(bags, weight) as selectedBaggage", "departure_country as departureCountry",
        "arrival_country as arrivalCountry", "plan as travelInsurance", "trip_cost as tripCost", "passengers as passengerCount",
    )
    for name, node in rule_models.load_model(models.PRICING).items():
        q = rule_models.evaluate(q, node, name)
    total = "aggregate({0}, 0D, (s, x) -> s + x.amount)".format
    return q.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "base.multiplier", "base.discount", "season.seasonal", "season.surcharge", f"{total('baggage')} as baggage_fees", f"round({total('tax')}, 2) as tax_total", "cast(coalesce(insurance.fee, 0) as double) as insurance_fee")


def _priced(name, *cols):
    def run(spark, d):
        return rules.price(samples.quotes(spark, d)).selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *cols)

    QUERIES[name] = run


_priced("R10_price_base", "multiplier", "discount")
_priced("R11_price_season", "season.seasonal as seasonal", "season.surcharge as surcharge")
_priced("R12_fee_baggage", "baggage_fees")
_priced("R13_fee_ancillary", "ancillary_fees")
_priced("R14_fee_tax", "round(tax_total, 2) as tax_total")
_priced("R15_fee_insurance", "insurance_fee")
_priced("R16_price_total", "grand_total")


def _recovered(name, branch):
    def run(spark, d):
        e = rules.route_error(samples.errors(spark, d)).where(F.col("branch") == branch)
        return e.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("recovery.action").alias("action"), F.col("recovery.next_step").alias("next_step"), F.col("recovery.extra").alias("extra"))

    QUERIES[name] = run


for _name, _branch in {"R17_recover_validation": "validation", "R18_recover_payment": "payment", "R19_recover_availability": "availability", "R20_recover_system": "system", "R21_recover_business_rule": "business_rule"}.items():
    _recovered(_name, _branch)


@query
def R22_error_response(spark, d):
    r = rules.error_response(samples.errors(spark, d))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "max_retries", "can_retry", "delay_seconds", "hold_minutes", "recovery_action")


@query
def R23_step_transitions(spark, d):
    return fold.step_transitions(_e(spark, d))


@query
def R24_phase_funnel(spark, d):
    return fold.phase_funnel(_e(spark, d))


@query
def R24_phase_gaps(spark, d):
    return fold.phase_gaps(_e(spark, d))


# read models


@query
def P1_project_journey_view(spark, d):
    e = _e(spark, d)
    v = views.journey_documents(e)
    return v.select("aggregate_id", "state", "current_step", "phase", F.array_join("actions", ",").alias("actions"), "version", "created_at", "updated_at", "shared_data")


def _people(spark, d):
    p = samples.personal_log(spark, d)
    forgets = admit.forget_events(samples.erasure_requests(spark, d), pii.slots(p).withColumn("forgotten", F.lit(False)))
    return views.persons(p, _live_keys(spark, d), forgets)


@query
def P2_project_persons(spark, d):
    return _people(spark, d)


@query
def P3_project_workflow_history(spark, d):
    return fold.workflow_history(_e(spark, d))


@query
def Q1_load_journey(spark, d):
    p = samples.personal_log(spark, d)
    scalars = p.groupBy("aggregate_id").agg(F.max("sequence").alias("version"))
    row = views.load(scalars, _people(spark, d), "o42")
    return row.select("aggregate_id", "version", F.size("persons").alias("n_persons"), F.get("persons", F.lit(0))["person_ref"].alias("first_ref"))


@query
def Q2_load_all(spark, d):
    p = samples.personal_log(spark, d)
    scalars = p.groupBy("aggregate_id").agg(F.max("sequence").alias("version"), F.max(F.col("event_type") == "JourneyClosed").alias("complete"))
    rows = views.load_all(scalars, _people(spark, d))
    return rows.select("aggregate_id", "version", "complete", F.coalesce(F.size("persons"), F.lit(0)).alias("n_persons"), F.array_join(F.transform("persons", lambda x: x["subject_id"]), ",").alias("subjects"))


@query
def Q2_load_journeys(spark, d):
    """Whole journeys: scalars, latest decision, document and persons."""
    people = log.parse_events(_person_events(spark, d))
    forgets = people.where("event_type = 'SubjectForgotten'")
    open_keys = people.select("subject_id").where("subject_id not like '%3'")
    rows = views.load_all(views.journey_documents(_e(spark, d)), views.persons(people, open_keys, forgets))
    return rows.select("aggregate_id", "state", "current_step", "phase", F.array_join("actions", ",").alias("actions"), "version", "created_at", "updated_at", "shared_data", F.coalesce(F.to_json("persons"), F.lit("[]")).alias("persons"))


@query
def Q3_page_journeys(spark, d):
    return views.page(fold.fold_scalars(_e(spark, d)), 1, 50).select("aggregate_id", "created_at")


@query
def Q4_load_persons(spark, d):
    return _people(spark, d).select("aggregate_id", "person_ref", "subject_id", "name", "email", "phone", "forgotten")


def _emails(spark, d):
    c = samples.read(spark, d, "customer").where("c_custkey % 50 = 7").select(F.expr("upper(concat('User', c_custkey % 1000, '@mail.example.com'))").alias("email"))
    return c


@query
def Q5_find_by_email(spark, d):
    return views.find_by_email(_people(spark, d), _emails(spark, d))


@query
def Q6_find_journeys_by_subject(spark, d):
    p = samples.personal_log(spark, d)
    m = views.subject_journeys(p, pii.extract_partitions(p))
    return m.join(samples.erasure_requests(spark, d), "subject_id", "left_semi").select("subject_id", "aggregate_id")


@query
def Q7_find_subjects_by_email(spark, d):
    index = keys.lookup(samples.personal_log(spark, d).where("event_type = 'PersonCaptured'"))
    return keys.subjects_by_email(index, _emails(spark, d))


@query
def Q8_maintain_subject_lookup(spark, d):
    return keys.lookup(samples.personal_log(spark, d).where("event_type = 'PersonCaptured'"), samples.erasure_requests(spark, d))


@query
def Q9_delete_subject_lookup(spark, d):
    return keys.delete_lookup(keys.lookup(samples.personal_log(spark, d).where("event_type = 'PersonCaptured'")), samples.erasure_requests(spark, d))


@query
def Q10_subject_journey_map(spark, d):
    p = samples.personal_log(spark, d)
    return views.subject_journeys(p, pii.extract_partitions(p))


@query
def Q11_kek_usage(spark, d):
    return keys.usage(samples.key_table(spark, d, MASTER))


@query
def Q12_unknown_kek_ids(spark, d):
    return keys.unknown_versions(samples.key_table(spark, d, MASTER), ["v2", "v3"])


@query
def Q13_inspect_raw_events(spark, d):
    p = pii.clear(samples.personal_log(spark, d))
    return p.where("aggregate_id = 'o42' and event_type = 'AttributesSet'").orderBy("sequence").select("aggregate_id", "sequence", "price", "passport_lead")


@query
def Q14_events_by_type(spark, d):
    return log.event_catalogue(_e(spark, d))


@query
def Q15_erasure_survival_report(spark, d):
    return views.survival(pii.decrypt(_sealed(spark, d), _live_keys(spark, d)))


# personal data


@query
def C1_extract_partitions(spark, d):
    return pii.extract_partitions(samples.personal_log(spark, d)).groupBy("subject_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def C1_details_partitions(spark, d):
    p = pii.details_partitions(log.parse_events(_person_events(spark, d)))
    data_keys = p.select("subject_id").distinct().withColumn("data_key", F.unhex(F.sha2("subject_id", 256)))
    return pii.details_read(pii.decrypt(pii.encrypt(p, data_keys), data_keys.where("subject_id not like '%3'")))


@query
def C4_decrypt_events(spark, d):
    got = pii.decrypt(_sealed(spark, d), _open_keys(spark, d))
    return pii.attributes_read(got).select("aggregate_id", "sequence", "label", "path", "value")


def _payload_log(spark, d):
    """samples.personal_log as a log with payloads, in clear."""
    p = samples.personal_log(spark, d)
    mine = Window.partitionBy("aggregate_id")
    bound = {r: F.min_by("subject_id", F.when((F.col("event_type") == "PersonCaptured") & (F.col("person_ref") == r), F.col("sequence"))).over(mine) for r in ("lead", "agent")}
    part = "if(passport_{0} is not null, named_struct('person_ref', '{0}', 'subject_id', {0}, 'changes', map('/persons/{0}/passportNumber', passport_{0})), null)".format
    payload = F.expr(f"""case event_type when 'PersonCaptured' then to_json(struct(struct(person_ref, subject_id, name, email, phone) as PersonCaptured))
        when 'AttributesSet' then to_json(struct(struct(map('/price', price) as plaintext, filter(array({part('lead')}, {part('agent')}), x -> x is not null) as secret_partitions) as AttributesSet))
        else concat('{{"', event_type, '":{{}}}}') end""")
    return p.withColumns(bound).select(F.lit("journey").alias("aggregate_type"), "aggregate_id", "sequence", "event_type", F.lit("1.0").alias("event_version"), payload.alias("payload"), F.col("timestamp").cast("timestamp").alias("timestamp"))


def _named(spark, d):
    """The subjects that journeys name."""
    return samples.personal_log(spark, d).where("event_type = 'PersonCaptured'").select("aggregate_id", "subject_id")


def _stored_log(spark, d):
    return stored.encrypt(_payload_log(spark, d), _open_keys(spark, d), subjects=_named(spark, d))


@query
def C3_encrypt_events(spark, d):
    e = stored.inspect(_stored_log(spark, d))
    price = F.expr("""try_variant_get(fields['plaintext'], '$["/price"]', 'double')""")
    return e.select("aggregate_id", "sequence", "event_type", F.array_join("subjects", ",").alias("subjects"), F.array_join("labels", ",").alias("labels"), F.col("n_bytes").cast("long").alias("n_bytes"), price.alias("price"))


def _payload_columns(e):
    """What payloads say, in clear or redacted, as columns."""
    get = lambda at, kind="string": F.expr(f"try_variant_get(doc, '$.{at}', '{kind}')")
    few = e.withColumn("doc", F.expr("try_parse_json(payload)")).withColumn("l", F.expr("try_variant_get(doc, '$.AttributesSet.secret_partitions', 'array<struct<person_ref string, changes map<string,string>>>')"))
    mine = lambda ref: F.expr(f"element_at(map_entries(get(filter(l, x -> x.person_ref = '{ref}'), 0).changes), 1)")
    few = few.withColumn("lead", mine("lead")).withColumn("agent", mine("agent"))
    return few.select(
        "aggregate_id", "sequence", "event_type", "status", get("PersonCaptured.subject_id").alias("subject_id"), *[get(f"PersonCaptured.{n}").alias(n) for n in ("name", "email", "phone")],
        get('AttributesSet.plaintext["/price"]', "double").alias("price"), *[F.col(f"{r}.{k}").alias(f"{r}_{n}") for r in ("lead", "agent") for k, n in (("key", "path"), ("value", "value"))],
    )


@query
def C5_reconstruct_events(spark, d):
    return _payload_columns(stored.decrypt(_stored_log(spark, d), _live_keys(spark, d), subjects=_named(spark, d)))


@query
def S4_scan_decrypted_log(spark, d):
    return _payload_columns(stored.decrypt(_stored_log(spark, d), _open_keys(spark, d), subjects=_named(spark, d)))


@query
def C6_redact_events(spark, d):
    got = pii.decrypt(_sealed(spark, d), _live_keys(spark, d))
    return pii.persons_read(got)


@query
def C8_read_legacy_ciphertext(spark, d):
    few = pii.PERSON.extract(samples.personal_log(spark, d))
    got = pii.decrypt_legacy(pii.encrypt_legacy(few, _open_keys(spark, d)), _live_keys(spark, d))
    return got.select("aggregate_id", "sequence", "subject_id", F.get_json_object("payload", "$.name").alias("name"), "status")


@query
def C9_audit_ciphertext_integrity(spark, d):
    moved = _sealed(spark, d).withColumn("sequence", F.when(F.col("label") == "agent", F.col("sequence") + 1).otherwise(F.col("sequence")))
    return pii.integrity(pii.decrypt(moved, _open_keys(spark, d)))


@query
def C11_ensure_keys(spark, d):
    p = pii.extract_partitions(samples.personal_log(spark, d))
    return keys.missing_subjects(p, _live_keys(spark, d))


@query
def C13_unwrap_keys(spark, d):
    k = keys.unwrap(samples.key_table(spark, d, MASTER), {"v2": MASTER["v2"]})
    return k.groupBy("kek_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def C14_list_stale_keys(spark, d):
    return keys.stale(samples.key_table(spark, d, MASTER), "v2").select("subject_id", "kek_id")


@query
def C15_rewrap_keys(spark, d):
    table = samples.key_table(spark, d, MASTER)
    new = keys.apply_rewrap(table, keys.rewrap(table, "v3", MASTER))
    same = keys.unwrap(new, {"v3": MASTER["v3"]})
    return same.select("subject_id", "kek_id", F.lower(F.hex("data_key")).alias("data_key"))


@query
def C16_rewrap_cas(spark, d):
    table = samples.key_table(spark, d, MASTER)
    delta = keys.rewrap(table, "v2", MASTER)
    return keys.usage(keys.apply_rewrap(keys.shred(table, samples.erasure_requests(spark, d)), delta))


@query
def C17_rollback_rotation(spark, d):
    return keys.rewrap(samples.key_table(spark, d, MASTER), "v1", MASTER).groupBy("old_kek_id", "kek_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def C18_shred_subjects(spark, d):
    return _live_keys(spark, d).select("subject_id", "kek_id")


@query
def C18_forgotten_events(spark, d):
    p = samples.personal_log(spark, d)
    erased = keys.erase(p, _open_keys(spark, d), keys.lookup(p.where("event_type = 'PersonCaptured'")), samples.erasure_requests(spark, d), views.subject_journeys(p))
    return erased["events"].select("aggregate_id", "subject_id", "sequence")


@query
def C19_shred_by_email(spark, d):
    index = keys.lookup(samples.personal_log(spark, d).where("event_type = 'PersonCaptured'"))
    return keys.usage(keys.shred(samples.key_table(spark, d, MASTER), keys.subjects_by_email(index, _emails(spark, d))))


@query
def C19_erase_by_email(spark, d):
    """All that is left of keys and lookup, and the events to append."""
    p = samples.personal_log(spark, d)
    done = keys.erase_by_email(p, samples.key_table(spark, d, MASTER), keys.lookup(p.where("event_type = 'PersonCaptured'")), _emails(spark, d), views.subject_journeys(p))
    rows = [df.select(F.lit(what).alias("what"), "subject_id", *([F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("aggregate_id", "string"), ("sequence", "long"))])) for what, df in done.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def C20_partial_shred_read(spark, d):
    return pii.decrypt(_sealed(spark, d), _live_keys(spark, d)).where("label <> 'default'").select("aggregate_id", "sequence", "label", "status")


@query
def C21_derive_subject_id(spark, d):
    c = samples.read(spark, d, "customer")
    email = F.expr("concat('  User', c_custkey % 1000, '@Mail.example.com')")
    return c.select("c_custkey", keys.subject_id(email, b"namespace").alias("id"))


@query
def C22_subject_linkage_report(spark, d):
    return keys.linkage(samples.personal_log(spark, d).where("event_type = 'PersonCaptured'"))


@query
def C22_subject_addresses(spark, d):
    return keys.addresses(log.parse_events(_person_events(spark, d)).where("event_type = 'PersonCaptured'"))


@query
def W7_backfill_subject_lookup(spark, d):
    people = views.persons(samples.personal_log(spark, d), _open_keys(spark, d))
    existing = keys.lookup(samples.personal_log(spark, d).where("event_type = 'PersonCaptured' and person_ref = 'agent'"))
    return keys.backfill_lookup(people, existing)


@query
def W8_backfill_kek_id(spark, d):
    old = samples.key_table(spark, d, MASTER).withColumn("kek_id", F.when(F.col("kek_id") == "v2", F.col("kek_id")))
    return keys.usage(keys.backfill_version(old))
