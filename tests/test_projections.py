import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradelake import schemas
from tradelake.operators import projections
from tradelake.sources import payloads as P

ORDER = {
    "id": 7001, "parentOrderId": 0, "orderTypeCode": "SO", "reference": "WEB-1",
    "orderStatus": {"orderStatusId": 3, "name": "Packed"},
    "placedOn": "2023-03-04T09:30:00.000-05:00", "updatedOn": "2023-03-05T00:00:00.000+01:00",
    "currency": {"orderCurrencyCode": "EUR", "exchangeRate": "1.100000"},
    "totalValue": {"net": "0.1", "taxAmount": "", "total": "99999999999999999.123456789"},
    "assignment": {"current": {"channelId": 4, "staffOwnerContactId": 0}},
    "parties": {"customer": {"contactId": 12, "companyName": "Acme", "email": "a@b.c"}},
    "invoices": [{"invoiceReference": "INV-9"}, {"invoiceReference": "INV-10"}],
    "orderRows": {
        "31": {"orderRowSequence": "10", "productId": 5, "quantity": {"magnitude": "3.0000"},
               "rowValue": {"rowNet": {"value": "12.30"}}, "productOptions": {"Size": "L"},
               "composition": {"bundleChild": True, "parentOrderRowId": 30}},
        "32": {"orderRowSequence": "", "productOptions": {}, "composition": {"parentOrderRowId": 0}},
    },
    "warehouseId": 2, "historicalOrder": True,
}


def frame(spark, *payloads):
    return spark.createDataFrame([(json.dumps(p),) for p in payloads], "raw_payload STRING")


def test_order_header(spark, now):
    row = projections.order_headers(frame(spark, ORDER), now).first()
    assert row["order_id"] == 7001
    assert row["parent_order_id"] is None
    assert row["staff_owner_contact_id"] == 0
    assert row["total_net"] == Decimal("0.1")
    assert row["total_tax"] is None
    assert row["total"] == Decimal("99999999999999999.123456789")
    assert row["placed_on"] == datetime(2023, 3, 4, 14, 30)
    assert row["updated_on"] == datetime(2023, 3, 4, 23)
    assert row["customer_company_name"] == "Acme"
    assert row["delivery_state"] is None
    assert row["invoice_reference"] == "INV-9"
    assert row["historical_order"] is True
    assert row["is_deleted"] is False and row["deleted_at"] is None
    assert json.loads(row["raw_payload"]) == ORDER


def test_order_header_schema(spark, now):
    got = projections.order_headers(frame(spark, ORDER), now).schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in schemas.ORDERS]
    assert len(schemas.ORDERS) == 38 and len(schemas.ORDER_ROWS) == 21
    assert len(schemas.PRODUCTS) == 20 and len(schemas.CONTACTS) == 20


def test_order_with_nothing_nested(spark, now):
    row = projections.order_headers(frame(spark, {"id": 1, "parties": None, "invoices": []}), now).first()
    assert row["order_id"] == 1
    assert row["customer_email"] is None and row["invoice_reference"] is None


def test_order_lines(spark, now):
    lines = {r["order_row_id"]: r for r in projections.order_lines(frame(spark, ORDER), now).collect()}
    assert set(lines) == {31, 32}
    first, second = lines[31], lines[32]
    assert first["order_id"] == 7001 and first["row_sequence"] == 10
    assert first["quantity"] == Decimal("3") and first["row_net"] == Decimal("12.3")
    assert json.loads(first["product_options"]) == {"Size": "L"}
    assert first["bundle_child"] is True and first["parent_order_row_id"] == 30
    assert first["order_updated_on"] == datetime(2023, 3, 4, 23)
    assert second["row_sequence"] is None and second["product_options"] is None
    assert second["parent_order_row_id"] is None


def test_free_keys_keep_their_values(spark, now):
    options = {"quantity": "", "itemCost": [], "rowValue": 0, "composition": False}
    payload = {"id": 1, "orderRows": {"2": {"quantity": "", "itemCost": [], "rowValue": 0, "composition": False, "productOptions": options}}}
    line = projections.order_lines(frame(spark, payload), now).first()
    assert json.loads(line["product_options"]) == options
    assert line["quantity"] is None and line["item_cost"] is None and line["row_net"] is None


@pytest.mark.parametrize("broken", [
    {"parties": "none"}, {"parties": {"customer": 5}}, {"assignment": [1]}, {"invoices": {"a": 1}}, {"currency": True},
])
def test_a_value_where_an_object_belongs_is_an_error(spark, now, broken):
    with pytest.raises(Exception, match="no (object|list)"):
        projections.order_headers(frame(spark, {"id": 1, **broken}), now).collect()


def test_payload_files(spark, now, tmp_path):
    docs = [{"response": [ORDER, {"id": 2}]}, {"id": 3, "reference": "alone"}, {"response": []}]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(d) for d in docs))
    records = P.read_payloads(spark, str(tmp_path))
    rows = projections.order_headers(records, now).orderBy("order_id").collect()
    assert [(r["order_id"], r["reference"]) for r in rows] == [(2, None), (3, "alone"), (7001, "WEB-1")]
    assert json.loads(rows[2]["raw_payload"]) == ORDER
    assert projections.order_lines(records, now).count() == 2


def test_a_payload_is_parsed_once(spark, now):
    plan = projections.order_lines(frame(spark, ORDER), now)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1, plan


@pytest.mark.parametrize("rows", [{}, None])
def test_orders_without_lines(spark, now, rows):
    assert projections.order_lines(frame(spark, {"id": 1, "orderRows": rows}), now).count() == 0


def test_bad_value_is_an_error(spark, now):
    bad = frame(spark, {"id": 1, "totalValue": {"net": "twelve"}})
    with pytest.raises(Exception, match="twelve"):
        projections.order_headers(bad, now).collect()


def test_product(spark, now):
    payload = {
        "id": 11, "brandId": 3, "identity": {"sku": "S-1", "barcode": ""},
        "stock": {"stockTracked": True, "weight": {"magnitude": 2.75}},
        "salesChannels": [{"productName": "Lamp"}, {"productName": "Other"}],
        "composition": {"bundle": False}, "status": "LIVE", "createdOn": "2020-01-01T00:00:00.000Z",
    }
    full, bare = projections.product_rows(frame(spark, payload, {"id": 12}), now).orderBy("product_id").collect()
    assert (full["sku"], full["name"], full["stock_tracked"]) == ("S-1", "Lamp", True)
    assert full["weight"] == Decimal("2.75") and full["barcode"] == ""
    assert bare["name"] is None and bare["weight"] is None


def test_contact(spark, now):
    payload = {
        "contactId": 5, "firstName": "Kim",
        "communication": {"emails": {"SEC": {"email": "x@y"}, "PRI": {"email": "kim@y"}},
                          "telephones": {"MOB": "1"}},
        "relationshipToAccount": {"isSupplier": True},
        "financialDetails": {"creditTermDays": 14}, "organisation": {"name": "Org"},
    }
    row = projections.contact_rows(frame(spark, payload), now).first()
    assert row["email"] == "kim@y" and row["telephone"] is None
    assert row["is_supplier"] is True and row["is_staff"] is None
    assert row["credit_term_days"] == 14 and row["organisation_name"] == "Org"


def test_prices(spark, now):
    payload = {"productId": 1, "priceLists": [
        {"priceListId": 1, "quantityPrice": {"1": "5.10", "10": "4"}},
        {"priceListId": 2, "quantityPrice": {}}, {"priceListId": 3},
        {"priceListId": 4, "quantityPrice": {"1": ""}}]}
    rows = {r["price_list_id"]: r for r in projections.price_rows(frame(spark, payload), now).collect()}
    assert rows[1]["price"] == Decimal("5.1")
    assert rows[2]["quantity_prices"] is None and rows[3]["price"] is None
    assert rows[4]["price"] is None and rows[4]["quantity_prices"] == '{"1":""}'


def test_availability(spark, now):
    payload = {"9": {"warehouses": {"1": {"onHand": 5, "allocated": 2}, "2": {"onHand": 0}}}, "10": {}}
    rows = projections.availability_rows(frame(spark, payload), now).collect()
    assert {(r["product_id"], r["warehouse_id"], r["on_hand"]) for r in rows} == {(9, 1, 5), (9, 2, 0)}


def test_suppliers(spark, now):
    products = spark.createDataFrame(
        [(1, '{"primarySupplierId": 20}', None), (2, '{"primarySupplierId": ""}', False),
         (3, '{"primarySupplierId": 5}', True), (4, None, None)],
        "product_id BIGINT, raw_payload STRING, is_deleted BOOLEAN",
    )
    raw = frame(spark, {"1": [20, 30], "2": [20], "3": [5], "4": [1]}, {"5": None})
    rows = projections.supplier_rows(raw, products, now).collect()
    flags = {(r["product_id"], r["supplier_contact_id"]): r["is_primary"] for r in rows}
    assert flags == {(1, 20): True, (1, 30): False, (2, 20): False, (3, 5): False, (4, 1): False}


def test_id_lists(spark):
    products = spark.createDataFrame(
        [(1, True, None), (2, False, None), (3, True, True)],
        "product_id BIGINT, stock_tracked BOOLEAN, is_deleted BOOLEAN",
    )

    def ids(df):
        return {r[0] for r in df.collect()}

    assert ids(projections.stock_tracked_ids(products)) == {1, 3}
    assert ids(projections.live_product_ids(products)) == {1, 2}
    assert ids(projections.all_product_ids(products)) == {1, 2, 3}


def test_members_are_read_in_one_pass_like_their_paths(spark):
    """Every path gives what a look-up of its own gives, also where a step is no object or no list."""
    texts = ['{"a":{"b":1.50,"c":{"d":"x"}},"l":[{"e":7},{"e":8}],"r":{"1":{"q":2}}}', '{"a":{"c":{}},"l":[],"r":{}}', '{"a":null,"l":null}',
             '{"a":{"b":{"z":[1,true]},"c":""},"l":[3]}', '{"a":"","l":"","r":""}', "{}", "null"]
    df = P.parse(spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n INT, raw_payload STRING"), "n")
    m = P.Members()
    paths = ["a.b", "a.c.d", "l[0].e"]
    columns = [m.text(p).alias(f"c{k}") for k, p in enumerate(paths)]
    rows = m.members("r")
    read = m.over(df, ("a.b", "a.c.d"), ("l",))
    found = read.select("n", *columns, F.to_json(rows).alias("r")).orderBy("n").collect()
    looked = df.select("n", *[P.text(p).alias(f"c{k}") for k, p in enumerate(paths)], F.to_json(P.members("r")).alias("r"))
    assert found == looked.orderBy("n").collect()
    for bad in ('{"a":5}', '{"a":{"c":[1]}}', '{"l":{"0":1}}', '{"r":[1]}'):
        with pytest.raises(Exception, match="no (object|list)"):
            m.over(P.parse(spark.createDataFrame([(bad,)], "raw_payload STRING")), ("a.b", "a.c.d"), ("l",)).select(*columns).collect()


def test_order_payloads_are_not_spread_over_a_fixed_number_of_tasks(spark):
    from tradelake.suite.payload_queries import order_payloads

    made = order_payloads({"orders": spark.createDataFrame([], schemas.ORDERS)})
    plan = made._jdf.queryExecution().analyzed().toString()
    assert f"Repartition {spark.conf.get('spark.sql.shuffle.partitions')}, true" in plan
