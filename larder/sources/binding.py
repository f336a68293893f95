"""Binding of marketplace concepts onto the driver's star schema.

Operators in ``larder.operators`` work on the canonical tables produced
here (snake_case columns, one row per entity). The binding is fixed once
and used everywhere (see README, "Binding"):

  orders          orders: order_id, buyer_id, order_date, created_at, total,
                  status, payment_status
  order_items     lineitem: order_id, line_no, product_id, supplier_id,
                  quantity, price, supplier_price, marketplace_price
  products        part: category = p_type, base price, stock, owner supplier
  suppliers       supplier rows as users with a verification status
  buyers          customer rows as users; city = nation name
  reviews         purchase events; notifications = all events
  invoices        one per order
  demand          lineitem as daily order history rows

Everything is lazy; nothing is collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.chat import CATEGORIES
from larder.sources.tables import read_table

# Fixed values of the binding.
AS_OF = "2001-08-01"          # "now" for every relative-date operator
DEFAULT_CREDIT_LIMIT = 100000  # used when a limit is missing or zero
FOOD = ["Fish", "Meat", "Vegetables", "Fruit", "Dairy", "Spices", "Seafood", "Poultry"]
SUPPLIER_PRICE_DIVISOR = 1.15  # supplier price = marketplace price / 1.15


def order_status(orderstatus: Column, priority: Column) -> Column:
    return (F.when(orderstatus == "F", "Delivered")
            .when(orderstatus == "O", "In Transit")
            .when(priority == "5-LOW", "Cancelled")
            .when(priority == "1-URGENT", "Pending Payment Verification")
            .otherwise("Pending"))


def payment_status(priority: Column) -> Column:
    return (F.when(priority == "1-URGENT", "Pending Verification")
            .when(priority == "2-HIGH", "Rejected")
            .otherwise("Approved"))


def payment_method(priority: Column) -> Column:
    return (F.when(priority == "3-MEDIUM", "net30")
            .when(priority == "1-URGENT", "bank").otherwise("card"))


def entry_status(linestatus: Column, returnflag: Column) -> Column:
    return (F.when(linestatus == "F", "Delivered")
            .when(returnflag == "R", "Cancelled")
            .when(returnflag == "A", "In Transit")
            .otherwise("Pending"))


def unit_price_micros(amount: str, qty: str) -> Column:
    """Unit price in millionths, HALF_UP, by integer arithmetic only (exact
    on every engine): (2 * cents * 10^4 + q) div (2 * q)."""
    cents = f"CAST(round({amount} * 100) AS BIGINT)"
    q = f"CAST({qty} AS BIGINT)"
    return F.expr(f"(2 * {cents} * 10000 + {q}) div (2 * {q})")


def weather_of(d: Column) -> Column:
    doy = F.dayofyear(d)
    return (F.when(F.pmod(doy, F.lit(3)) == 0, "Sunny")
            .when(F.pmod(doy, F.lit(3)) == 1, "Rainy").otherwise("Cloudy"))


def holiday_of(d: Column) -> Column:
    return (F.pmod(F.dayofyear(d), F.lit(10)) == 0).cast("int")


class Marketplace:
    """Canonical marketplace tables over one driver data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- orders and items -------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("buyer_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_totalprice").alias("total"),
            order_status(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("status"),
            payment_status(F.col("o_orderpriority")).alias("payment_status"),
            payment_method(F.col("o_orderpriority")).alias("payment_method"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        li = self.raw("lineitem")
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_quantity").alias("quantity"),
            price.alias("price"),
            F.when(F.col("l_returnflag") == "N", F.lit(None).cast("double"))
             .otherwise(price / SUPPLIER_PRICE_DIVISOR).alias("supplier_price"),
            price.alias("marketplace_price"),
            F.col("l_linestatus").alias("line_status"),
            F.col("l_returnflag").alias("return_flag"),
            F.to_date("l_shipdate").alias("ship_date"),
            # The (order, supplier) status entry is the one of the first line;
            # carrying rank + status per line lets one aggregate pick it.
            # rank of the line within its (order, supplier): line number,
            # then (line status, return flag) in lexicographic order
            (F.col("l_linenumber").cast("bigint") * 8
             + F.when(F.col("l_linestatus") == "O", 3).otherwise(0)
             + F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0))
             .alias("entry_rank"),
            F.when(F.pmod("l_suppkey", F.lit(10)) != 0,
                   entry_status(F.col("l_linestatus"), F.col("l_returnflag")))
             .alias("entry_status"),
        )

    # -- catalogue and users ----------------------------------------------
    @cached_property
    def suppliers(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        status = (F.when(F.pmod(k, F.lit(4)) != 0, "approved")
                  .when(F.pmod(k, F.lit(8)) == 0, "rejected")
                  .otherwise("pending"))
        return s.select(
            k.alias("user_id"),
            F.col("s_name").alias("name"),
            F.when(F.pmod(k, F.lit(5)) == 0, F.lit(""))
             .otherwise(F.regexp_replace("s_name", "Supplier#", "Company #")).alias("company"),
            F.lit("supplier").alias("role"),
            status.alias("verification_status"),
            (status == "approved").alias("is_verified"),
            F.col("s_nationkey").alias("nation_key"),
        )

    @cached_property
    def buyers(self) -> DataFrame:
        c = self.raw("customer")
        n = self.raw("nation")  # 25 rows, fixed: safe to broadcast
        k = F.col("c_custkey")
        return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
                .select(
                    k.alias("user_id"),
                    F.col("c_name").alias("name"),
                    F.lit("buyer").alias("role"),
                    F.col("n_name").alias("city"),
                    F.when(F.pmod(k, F.lit(10)) == 0, F.lit(0))
                     .otherwise(F.lit(1000000)).cast("double").alias("credit_limit"),
                ))

    @cached_property
    def products(self) -> DataFrame:
        """part as products; owner = p_partkey mod (number of suppliers).

        The supplier count is a scalar subquery, evaluated once per query.
        """
        p = self.raw("part")
        n_sup = self.raw("supplier").select(F.count(F.lit(1))).scalar()
        size = F.col("p_size")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").alias("price"),
            F.col("p_retailprice").alias("base_price"),
            ((size - 1) * 2).alias("stock"),
            (F.pmod(size, F.lit(10)) != 0).alias("is_active"),
            F.pmod(F.col("p_partkey"), n_sup).alias("supplier_id"),
            F.col("p_brand").alias("brand"),
        )

    # -- reviews, notifications, invoices ----------------------------------
    @cached_property
    def reviews(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "purchase")
        k = F.col("event_id")
        return e.select(
            k.alias("review_id"),
            F.col("user_id"),
            F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("user_name"),
            F.when(F.pmod(k, F.lit(4)) == 0, F.lit(None).cast("bigint"))
             .otherwise(F.pmod(k, F.lit(50))).alias("product_id"),
            (F.pmod(k, F.lit(5)) + 1).cast("int").alias("rating"),
            F.when(F.pmod(k, F.lit(3)) == 0, "approved")
             .when(F.pmod(k, F.lit(3)) == 1, "pending").otherwise("rejected").alias("status"),
            (F.pmod(k, F.lit(7)) == 0).alias("featured"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def notifications(self) -> DataFrame:
        e = self.raw("events")
        t = F.col("event_type")
        ntype = (F.when(t == "purchase", "payout").when(t == "click", "order")
                 .when(t == "view", "stock").otherwise("system"))
        return e.select(
            F.col("event_id").alias("notification_id"),
            F.col("user_id"),
            ntype.alias("type"),
            F.initcap(t).alias("title"),
            (t == "view").alias("read"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def invoices(self) -> DataFrame:
        o = self.raw("orders")
        st = F.col("o_orderstatus")
        return o.select(
            F.col("o_orderkey").alias("invoice_id"),
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("buyer_id"),
            F.col("o_totalprice").alias("amount"),
            F.when(st == "F", "Paid").when(st == "O", "Unpaid").otherwise("Overdue").alias("status"),
            F.to_date("o_orderdate").alias("issue_date"),
            F.date_add(F.to_date("o_orderdate"), 30).alias("due_date"),
        )

    # -- demand history ----------------------------------------------------
    @cached_property
    def demand(self) -> DataFrame:
        """Daily order-history rows: (date, product, category, qty, price, ...).

        ``part`` is joined on its key; AQE decides broadcast vs shuffle from
        the runtime size (part grows with the data, so no hint is forced).
        """
        li = self.raw("lineitem")
        p = self.raw("part").select("p_partkey", "p_type", "p_name")
        d = F.to_date("l_shipdate")
        return (li.join(p, li.l_partkey == p.p_partkey, "inner")
                .select(
                    d.alias("date"),
                    F.col("l_partkey").alias("product_id"),
                    F.col("p_name").alias("product_name"),
                    F.col("p_type").alias("category"),
                    F.col("l_quantity").alias("quantity_sold"),
                    (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                    unit_price_micros("l_extendedprice", "l_quantity").alias("price_micros"),
                    weather_of(d).alias("weather_condition"),
                    holiday_of(d).alias("is_holiday"),
                    F.col("l_orderkey").alias("order_id"),
                    F.col("l_linenumber").alias("line_no"),
                    F.col("l_suppkey").alias("supplier_id"),
                ))

    @cached_property
    def signups(self) -> DataFrame:
        """Sign-up events as user registrations (user_id, created_at)."""
        e = self.raw("events").where(F.col("event_type") == "signup")
        return e.select("user_id", F.col("ts").alias("created_at"), F.col("event_id"))

    @cached_property
    def payment_requests(self) -> DataFrame:
        """Invoice payment attempts: click events (payer = user, invoice = event id)."""
        e = self.raw("events").where(F.col("event_type") == "click")
        return e.select(F.col("event_id").alias("request_id"), F.col("event_id").alias("invoice_id"),
                        "user_id", F.col("ts").alias("requested_at"))

    @cached_property
    def credit_requests(self) -> DataFrame:
        """Credit-limit requests: error events, target = 1,000,000 + value x 10,000."""
        e = self.raw("events").where(F.col("event_type") == "error")
        return e.select(F.col("event_id").alias("request_id"), "user_id",
                        F.col("ts").alias("requested_at"),
                        (F.lit(1000000.0) + F.col("value") * F.lit(10000.0)).alias("target"))

    @cached_property
    def messages(self) -> DataFrame:
        """User turns of ``conversations``, and the chat requests under the ids -1, -2, .."""
        c = self.raw("conversations").where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("message"))
        return c.unionByName(self.chat_requests.select((-1 - F.col("conv_id")).alias("conv_id"), "turn", "message"))

    @cached_property
    def chat_products(self) -> DataFrame:
        """The products, named and classed by food word (product id mod 8)."""
        word = F.element_at(F.array(*[F.lit(w) for w in FOOD]), (F.pmod("product_id", F.lit(len(FOOD))) + 1).cast("int"))
        return self.products.withColumn("name", F.concat("name", F.lit(" "), F.lower(word))).withColumn("category", word)

    @cached_property
    def chat_requests(self) -> DataFrame:
        """Questions of click events: (event id div 3) mod 14 picks the question. Users
        whose event id is divisible by 3 are guests; for the questions 0 and 3 the user
        is the buyer of the order asked about."""
        e = self.raw("events").where(F.col("event_type") == "click").withColumn("q", F.pmod(F.expr("event_id div 3"), F.lit(14)))
        n_orders = self.raw("orders").select(F.count(F.lit(1))).scalar()
        n_parts = self.raw("part").select(F.count(F.lit(1))).scalar()
        e = e.withColumn("o", F.pmod("event_id", n_orders)).withColumn("p", F.pmod("event_id", n_parts))
        e = (e.join(self.orders.select(F.col("order_id").alias("o"), F.col("buyer_id")), "o", "left")
             .join(self.chat_products.select(F.col("product_id").alias("p"), F.col("name").alias("product")), "p", "left"))
        name = F.coalesce("product", F.lit("anything"))
        word = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.pmod("event_id", F.lit(10)) + 1).cast("int"))
        order = lambda c, n: F.lpad(c.cast("string"), n, "0")
        first = F.element_at(F.split(name, " "), 1)
        texts = [F.concat(F.lit("status of order "), order(F.col("o"), 24)), F.concat(F.lit("status of order "), order(F.col("o"), 24)),
                 F.concat(F.lit("track order "), order(F.col("o") + 1_000_000_000, 24)), F.concat(F.lit("order "), order(F.col("o"), 8)),
                 F.lit("track my orders"), F.concat(F.lit("price of "), name), F.concat(F.lit("is there any "), first),
                 F.lit("price of unobtainium"), F.lit("how much"), F.concat(F.lit("show me "), word, F.lit(" products")),
                 F.lit("any unread notifications?"), F.lit("what do clients say?"), F.lit("help me"), F.concat(F.lit("zzz "), first)]
        user = F.when(F.pmod("event_id", F.lit(3)) == 0, None).when(F.col("q").isin(0, 3), F.col("buyer_id")).otherwise(F.col("user_id"))
        return e.select(F.col("event_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), user.cast("long").alias("user_id"),
                        F.element_at(F.array(*texts), (F.col("q") + 1).cast("int")).alias("message"))
