"""Rule models in the cell language, as JSON texts that operators.models.load_model reads."""

from __future__ import annotations

import json


def _table(name: str, policy: str, inputs: list[str], outputs: list[str], rules: list[list[str]]) -> dict:
    """A decision table: an input is a field, or "" for conditions of their own; a rule has a cell for each input and each output."""
    ids = [f"c{i}" for i in range(len(inputs) + len(outputs))]
    head = [{"id": i, "field": f} for i, f in zip(ids, inputs + outputs)]
    content = {"hitPolicy": policy, "inputs": head[: len(inputs)], "outputs": head[len(inputs) :], "rules": [dict(zip(ids, r)) for r in rules]}
    return {"id": name, "name": name, "type": "decisionTableNode", "content": content}


def _columns(name: str, expressions: dict[str, str]) -> dict:
    return {"id": name, "name": name, "type": "expressionNode", "content": {"expressions": [{"key": k, "value": v} for k, v in expressions.items()], "passThrough": True}}


def _model(*nodes: dict) -> str:
    names = [n["id"] for n in nodes]
    return json.dumps({"nodes": nodes, "edges": [{"sourceId": a, "targetId": b} for a, b in zip(names, names[1:])]})


# The cells of the models below.
PHASE = _model(
    _columns("people", {"persons_list": "persons != null ? values(persons) : []"}),
    _columns("passengers", {
        "passenger_counts.found": "len(persons_list)",
        "passenger_counts.required": "number(search.passengers.adults ?? 0) + number(search.passengers.children ?? 0) + number(search.passengers.infants ?? 0)",
    }),
    _columns("flags", {
        "computed.hasSearch": "search.origin != null and search.destination != null",
        "computed.hasOutbound": "booking.selectedOutboundFlight != null",
        "computed.hasReturn": "booking.selectedReturnFlight != null",
        "computed.isRoundTrip": "search.tripType == 'round-trip'",
        "computed.paymentDone": "booking.paymentStatus == 'completed'",
        "computed.passengersComplete": "passenger_counts.found >= passenger_counts.required and passenger_counts.found > 0 and all(persons_list, #.passengerType != null)",
    }),
    _table("phase", "first", ["computed.paymentDone", "computed.hasSearch", "computed.hasOutbound", "computed.isRoundTrip", "computed.hasReturn", "computed.passengersComplete"], ["phase", "actions"], [
        ["true", "", "", "", "", "", "'booking_confirmed'", "['booking_confirmation']"],
        ["", "false", "", "", "", "", "'collecting_search'", "[]"],
        ["", "true", "false", "", "", "", "'selecting_outbound'", "['flight_search_results']"],
        ["", "true", "true", "true", "false", "", "'selecting_return'", "['return_flight_selection', 'flight_search_results']"],
        ["", "true", "", "", "", "false", "'collecting_passengers'", "['passenger_details']"],
        ["", "true", "", "", "", "true", "'collecting_payment'", "['seat_selection', 'passenger_details']"],
    ]),
)
PRICING = _model(
    _table("base", "first", ["cabinClass", "", ""], ["multiplier", "discount"], [
        ["'first'", "distance <= 2000", "", "3.5", "0"],
        ["'first'", "distance > 2000", "", "4.2", "0"],
        ["'business'", "distance <= 2000", "", "2.1", "0"],
        ["'business'", "distance > 2000", "", "2.8", "0"],
        ["'premium-economy'", "", "date(departureDate) - date(now()) > 21", "1.4", "0.05"],
        ["'premium-economy'", "", "", "1.4", "0"],
        ["'economy'", "", "date(departureDate) - date(now()) > 14", "1.0", "0.1"],
        ["'economy'", "", "", "1.0", "0"],
    ]),
    _table("season", "first", ["", ""], ["seasonal", "surcharge"], [
        ["month(date(departureDate)) in [6, 7, 8, 12]", "", "1.25", "0"],
        ["month(date(departureDate)) in [4, 5, 9, 10]", "", "1.1", "0"],
        ["month(date(departureDate)) in [1, 2, 3, 11]", "weekday(date(departureDate)) in [0, 6]", "0.9", "25"],
        ["", "", "0.9", "0"],
    ]),
    _table("baggage", "collect", ["cabinClass", "selectedBaggage.bags", "selectedBaggage.weight", ""], ["kind", "amount"], [
        ["in ['first', 'business']", "<= 2", "<= 32", "", "'baggage'", "0"],
        ["'economy'", "== 1", "<= 23", "distance <= 2000", "'baggage'", "25"],
        ["'economy'", "== 1", "<= 23", "distance > 2000", "'baggage'", "0"],
        ["'economy'", "== 2", "<= 23", "", "'baggage'", "35"],
        ["", "", "> 23 && <= 32", "", "'overweight'", "100"],
        ["", "", "> 32", "", "'heavy_bag'", "200"],
    ]),
    _table("tax", "collect", ["departureCountry", "arrivalCountry", ""], ["kind", "amount"], [
        ["'US'", "", "", "'Departure Tax'", "5.60"],
        ["'US'", "", "", "'Security Fee'", "5.60"],
        ["'US'", "!= 'US'", "departureCountry != arrivalCountry", "'Immigration Fee'", "7.00"],
        ["!= 'US'", "'US'", "true", "'Arrival Tax'", "18.30"],
        ["", "", "departureCountry == arrivalCountry", "'Fuel Surcharge'", "15.00"],
        ["", "", "departureCountry != arrivalCountry", "'Fuel Surcharge'", "45.00"],
    ]),
    _table("insurance", "first", ["travelInsurance", "tripCost"], ["fee", "coverage"], [
        ["== null", "", "0", "0"],
        ["== 'basic'", "< 1000", "25 * passengerCount", "5000"],
        ["== 'standard'", "[1000..5000]", "45 * passengerCount", "10000"],
        ["== 'premium'", "> 5000", "75 * passengerCount", "25000"],
    ]),
)
