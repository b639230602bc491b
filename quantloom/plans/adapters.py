"""Panels (date, id, value) from the TPC-H-like tables.

Two-decimal columns are summed as decimals, so both engines get the same doubles whatever their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Tables of one folder and the panels made from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def nation_month(self) -> DataFrame:
        """(date, id, close): order totals by month and nation of the customer."""
        o = self.orders.join(self.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        return o.groupBy(F.trunc("o_orderdate", "month").alias("date"), F.col("c_nationkey").cast("long").alias("id")).agg(cents("o_totalprice").alias("close"))

    def supplier_month(self) -> DataFrame:
        return self.lineitem.groupBy(F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").alias("id")).agg(cents("l_extendedprice").alias("value"), cents("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))

    def supplier_week(self) -> DataFrame:
        return self.lineitem.groupBy(F.trunc("l_shipdate", "week").alias("date"), F.col("l_suppkey").alias("id")).agg(cents("l_extendedprice").alias("value"))

    def user_day(self) -> DataFrame:
        return self.events.groupBy(F.col("ts").cast("date").alias("date"), F.col("user_id").alias("id")).agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("value"))

    def nation_panel(self) -> DataFrame:
        """(date, id, close, return, signal, fwd): percent return, the same as a signal, and the next return."""
        w = Window.partitionBy("id").orderBy("date")
        p = self.nation_month()
        p = p.withColumn("return", F.coalesce((F.col("close") / F.lag("close").over(w) - 1) * 100, F.lit(0.0)))
        return p.withColumns({"signal": F.col("return"), "fwd": F.lead("return").over(w)})

    def supplier_panel(self) -> DataFrame:
        """(date, id, value, quantity, n, signal, signal2, signal3, fwd_1, fwd_3, fwd_6): levels as signals, later
        relative changes as forward returns."""
        w = Window.partitionBy("id").orderBy("date")
        p = self.supplier_month()
        ahead = {f"fwd_{h}": F.lead("value", h).over(w) / F.col("value") - 1 for h in (1, 3, 6)}
        return p.withColumns({"signal": F.col("value"), "signal2": F.col("quantity") / F.col("n"), "signal3": F.col("value") / F.col("n"), **ahead})

    def supplier_groups(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("sector"))

    def weights(self) -> DataFrame:
        """(date, id, weight): share of a supplier in its month."""
        total = F.sum(F.col("value").cast("decimal(28,2)")).over(Window.partitionBy("date")).cast("double")
        return self.supplier_month().select("date", "id", (F.col("value") / total).alias("weight"))

    def nav(self) -> DataFrame:
        """(date, nav): order totals by month."""
        return self.orders.groupBy(F.trunc("o_orderdate", "month").alias("date")).agg(cents("o_totalprice").alias("nav"))

    def series(self) -> DataFrame:
        """(date, return_1d) of the monthly totals."""
        return self.nav().select("date", (F.col("nav") / F.lag("nav").over(Window.orderBy("date")) - 1).alias("return_1d")).where("return_1d is not null")

    def daily(self) -> DataFrame:
        """(date, return_1d): small daily returns from order totals."""
        d = self.orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(cents("o_totalprice").alias("v"))
        return d.select("date", ((F.pmod(F.round(F.col("v") * 100).cast("long"), F.lit(2001)) - 1000) / F.lit(1e5)).alias("return_1d"))


def cents(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


#: The same panels as named subqueries of DuckDB.
CTE = {
    "nation_month": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(c_nationkey AS BIGINT) AS id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "supplier_month": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "supplier_week": "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_suppkey AS id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2",
    "user_day": "SELECT CAST(ts AS DATE) AS date, user_id AS id, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS value FROM events GROUP BY 1, 2",
    "nation_panel": "SELECT *, ret AS signal, lead(ret) OVER (PARTITION BY id ORDER BY date) AS fwd FROM (SELECT *, coalesce((close / lag(close) OVER (PARTITION BY id ORDER BY date) - 1) * 100, 0.0) AS ret FROM nation_month)",
    "supplier_panel": "SELECT *, value AS signal, quantity / n AS signal2, value / n AS signal3, lead(value, 1) OVER w / value - 1 AS fwd_1, lead(value, 3) OVER w / value - 1 AS fwd_3, lead(value, 6) OVER w / value - 1 AS fwd_6 FROM supplier_month WINDOW w AS (PARTITION BY id ORDER BY date)",
    "supplier_groups": "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS sector FROM supplier",
    "weights": "SELECT date, id, value / CAST(sum(CAST(value AS DECIMAL(28,2))) OVER (PARTITION BY date) AS DOUBLE) AS weight FROM supplier_month",
    "nav": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS nav FROM orders GROUP BY 1",
    "series": "SELECT * FROM (SELECT date, nav / lag(nav) OVER (ORDER BY date) - 1 AS return_1d FROM nav) WHERE return_1d IS NOT NULL",
    "daily": "SELECT date, (CAST(round(v * 100) AS BIGINT) % 2001 - 1000) / 1e5 AS return_1d FROM (SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1)",
}
_NEEDS = {"nation_panel": ["nation_month"], "supplier_panel": ["supplier_month"], "weights": ["supplier_month"], "series": ["nav"]}


def sql(body: str, *names: str, **more: str) -> str:
    """A query over the named panels and further subqueries, in order."""
    order: list[str] = []
    for n in names:
        for x in (*_NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
