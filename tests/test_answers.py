"""Chat answers: every branch is reached, one answer per message."""

import json
from collections import Counter

from larder.plans import answers as pa
from larder.sources.binding import Marketplace
from tests.conftest import MEDIUM


def test_every_branch_is_reached(spark):
    rows = pa.chat_answers(spark, MEDIUM).collect()
    asked = Marketplace(spark, MEDIUM).chat_requests.count()
    assert len(rows) == asked == len({(r.conv_id, r.turn) for r in rows})
    data = [(r, json.loads(r.data)) for r in rows]
    kinds = Counter(r.response_type for r in rows)
    assert set(kinds) == {"order_status", "product_info", "category_search", "notifications", "reviews", "fallback", "general_help"}
    orders = [d for r, d in data if r.response_type == "order_status"]
    assert {d.get("status") for d in orders} >= {404, 403} and any(d["orderFound"] for d in orders)
    assert any(d.get("recentOrders") for d in orders) and any("text" in d for d in orders)
    assert all(d["order"]["timeline"][0]["label"] == "Order Placed" for d in orders if d["orderFound"])
    products = [d for r, d in data if r.response_type == "product_info"]
    in_stock = [d for d in products if d["inStock"]]
    out = [d for d in products if d["product"] and not d["inStock"]]
    gone = [d for d in products if d["product"] is None]
    assert in_stock and out and gone and {d["queryType"] for d in products} == {"price", "stock"}
    assert all(not d["alternatives"] for d in in_stock)
    # three of the same category, or the cheapest of all
    assert any([a["category"] for a in d["alternatives"]] == [d["product"]["category"]] * 3 for d in out)
    assert all(len(d["alternatives"]) == 5 for d in gone)
    listed = [d for r, d in data if r.response_type == "category_search"]
    assert any(len(d["products"]) == 10 for d in listed)
    lost = {d["message"] for r, d in data if r.response_type == "fallback"}
    assert len(lost) >= 2 and all(d["products"] for r, d in data if r.response_type == "fallback")
    notes = [d for r, d in data if r.response_type == "notifications"]
    assert any("text" in d for d in notes) and any(d["notifications"] for d in notes)
    assert {d["userName"] == "Guest" for r, d in data if r.response_type == "general_help"} == {True, False}
    assert all(len(d["reviews"]) == 3 for r, d in data if r.response_type == "reviews")
