"""The engine's tables as views of the given ones: bars, bench, membership, positions, chain, monthly, fundamentals and others.

SQL holds the same views for DuckDB, by name, each using only views before it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

#: Trades that a task gets at a time, about, where windows by symbol or sums by portfolio follow.
TRADES_A_PART = 100_000


def sum_in_order(value: Column | str, *order: Column | str) -> Column:
    """Doubles added one after another in the given order: the last bit then doesn't hang on how rows were dealt to tasks. Null without any."""
    v = F.col(value) if isinstance(value, str) else value
    rows = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(*order, v.alias("v")))))
    return F.aggregate(rows, F.lit(None).cast("double"), lambda a, r: F.coalesce(a, F.lit(0.0)) + r["v"])


class Tables:
    """The given tables of one folder, and the views made of them; nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def in_place(self, name: str, *columns: Column | str) -> DataFrame:
        """Columns of a table with each row's place in its files, __file and __row."""
        return self.table(name).select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def by_symbol(self, trades: DataFrame) -> DataFrame:
        """Trades dealt out by symbol into parts of about TRADES_A_PART: a task's memory then stays the same however large the table is."""
        return self._dealt(trades, "symbol")

    def _dealt(self, trades: DataFrame, key: str) -> DataFrame:
        return trades.repartition(self.table("lineitem").count() // TRADES_A_PART + 1, key)  # the count is in the files' footers

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars: symbol, date, open, high, low, close, volume.

        Trades go to their symbol's part first: few of them share a day, so adding them up before the shuffle saves nothing, and
        windows and aggregates by symbol then need no second one.
        """
        price = F.col("l_extendedprice") / F.col("l_quantity")
        at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        trades = self.table("lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), price.alias("price"), at.alias("at"), "l_quantity")
        return self.by_symbol(trades).groupBy("symbol", "date").agg(
            F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("l_quantity").alias("volume"),
        )

    @cached_property
    def bench(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))

    @cached_property
    def membership(self) -> DataFrame:
        nations = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
        return self.table("supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("index_name"), F.col("r_name").alias("universe"))

    @cached_property
    def positions(self) -> DataFrame:
        """What a portfolio holds. Trades go to their portfolio's part once: few share a symbol too, and what is asked of a portfolio then needs no second exchange."""
        lines = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        lines = lines.select(F.col("o_custkey").alias("portfolio"), F.col("l_suppkey").alias("symbol"), "l_quantity", "l_extendedprice")
        return self._dealt(lines, "portfolio").groupBy("portfolio", "symbol").agg(
            F.sum("l_quantity").cast("long").alias("quantity"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("avg_cost"),
        )

    @cached_property
    def last_close(self) -> DataFrame:
        """The close of each symbol's newest bar: the price of its last trade, found without making the bars, so that only a row a symbol is shuffled."""
        at = F.unix_date(F.to_date("l_shipdate")).cast("decimal(7,0)") * F.lit(str(10**20)).cast("decimal(21,0)") + (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(20,0)")
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.max_by(F.col("l_extendedprice") / F.col("l_quantity"), at).alias("last_close"))

    @cached_property
    def holdings(self) -> DataFrame:
        """positions with their value: portfolio, symbol, sector, quantity, avg_cost, last_close, invested, present, pnl."""
        last = written(self.last_close, "last-close")  # a row a symbol, whose size Spark then knows before it moves the positions
        p = self.positions.join(last, "symbol").join(self.membership, "symbol")
        p = p.withColumn("invested", F.col("quantity") * F.col("avg_cost")).withColumn("present", F.col("quantity") * F.col("last_close"))
        return p.withColumn("pnl", F.col("present") - F.col("invested")).withColumnRenamed("index_name", "sector").drop("universe")

    @cached_property
    def chain(self) -> DataFrame:
        lines = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        kind = F.when(F.col("l_linestatus") == "F", "CE").otherwise("PE")
        return lines.groupBy(F.col("p_brand").alias("underlying"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("expiry"), F.col("p_size").alias("strike"), kind.alias("type")).agg(
            F.sum("l_quantity").alias("oi"), F.avg("p_retailprice").alias("und_price"),
        )

    @cached_property
    def monthly(self) -> DataFrame:
        return self.table("orders").groupBy(F.concat(F.lit("m_"), F.col("o_orderpriority")).alias("indicator"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).agg(F.sum("o_totalprice").alias("value"))

    @cached_property
    def fundamentals(self) -> DataFrame:
        """One row a company and year with every line item the scores use."""
        x = F.col("l_extendedprice")
        flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, x).otherwise(0.0))
        base = self.table("lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.year("l_shipdate").alias("fy")).agg(
            F.sum(x).alias("revenue"), F.sum(x * (0.5 + F.col("l_discount"))).alias("cogs"), F.sum(x * F.col("l_tax")).alias("tax"),
            flag("N").alias("receivables"), flag("A").alias("inventory"), flag("R").alias("total_debt"), (F.sum(x) * 1.5).alias("total_assets"),
            F.sum(x * (0.4 - F.col("l_discount") - F.col("l_tax"))).alias("net_income"), F.sum(x * (0.42 - 2 * F.col("l_discount"))).alias("operating_cf"),
        )
        return base.withColumns({name: F.expr(e) for name, e in ITEMS.items()})

    @cached_property
    def fundamentals_in_order(self) -> DataFrame:
        """fundamentals whose revenue is added up in the rows' own order, for scores that hang on its last bit: total assets are a multiple of it, so whether their turnover rose is told by rounding alone."""
        trades = self.in_place("lineitem", F.col("l_suppkey").alias("symbol"), F.year("l_shipdate").alias("fy"), F.col("l_extendedprice").alias("x"))
        revenue = self._dealt(trades, "symbol").groupBy("symbol", "fy").agg(sum_in_order("x", "__file", "__row").alias("__revenue"))
        own = [c for c in self.fundamentals.columns if c not in ITEMS]
        base = self.fundamentals.select(*own).join(revenue, ["symbol", "fy"])
        base = base.withColumn("revenue", F.col("__revenue")).withColumn("total_assets", F.col("__revenue") * 1.5)
        return base.select(*own).withColumns({name: F.expr(e) for name, e in ITEMS.items()})

    @cached_property
    def quarters(self) -> DataFrame:
        """One row a company and quarter: symbol, quarter_end, revenue, net_income, ebitda."""
        x = F.col("l_extendedprice")
        end = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate"), 2))
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("symbol"), end.alias("quarter_end")).agg(
            F.sum(x).alias("revenue"), F.sum(x * (0.4 - F.col("l_discount") - F.col("l_tax"))).alias("net_income"), F.sum(x * (0.5 - F.col("l_discount") - F.col("l_tax") / 2)).alias("ebitda"),
        )

    @cached_property
    def stakes(self) -> DataFrame:
        """Quarter-end stakes: ticker (customer), as_of, pct. Amounts are added up in the rows' own order, so that equal ones give equal stakes to the last bit."""
        q = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2))
        orders = self.in_place("orders", F.col("o_custkey").alias("ticker"), q.alias("as_of"), "o_totalprice").repartition("ticker")
        return orders.groupBy("ticker", "as_of").agg((F.pmod(sum_in_order("o_totalprice", "__file", "__row"), F.lit(3000.0)) / 100).alias("pct"))

    @cached_property
    def flows(self) -> DataFrame:
        """Daily flows by sector (customer segment): date, sector, buy, sell, net."""
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        amount = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).otherwise(0.0))
        f = o.groupBy(F.to_date("o_orderdate").alias("date"), F.col("c_mktsegment").alias("sector")).agg(amount("O").alias("buy"), amount("F").alias("sell"))
        return f.withColumn("net", F.col("buy") - F.col("sell"))

    @cached_property
    def filings(self) -> DataFrame:
        """Filing texts made from orders, one of WORDINGS by key: doc_id, symbol, date, raw, text."""
        raw = F.format_string("%,.2f", F.col("o_totalprice"))
        o = self.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), raw.alias("raw"))
        wording = F.element_at(F.array(*[F.lit(w) for w in WORDINGS]), (F.col("doc_id") % len(WORDINGS) + 1).cast("int"))
        return o.withColumn("text", F.replace(wording, F.lit("@"), F.col("raw")))

    @cached_property
    def deals(self) -> DataFrame:
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        side = F.when(F.col("o_orderstatus") == "F", "S").otherwise("B")
        return o.select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("code"), F.col("c_name").alias("client"), side.alias("side"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("client_id"))


#: Wordings of the made filings; @ stands for an amount.
WORDINGS = (
    "Order book stood at Rs. @ crore as on date. We expect strong growth and outlook. Rating CRISIL AA+ / Stable outlook assigned.",
    "The unexecuted order book is Rs 2.5 lakh crore. There is a risk of delay and decline. ICRA BBB rating reaffirmed, Negative outlook.",
    "Acquisition of 12,500 equity shares, 1.25% of capital, bought at @. Guidance for the full year is on track.",
    "Disposal: sold 3,400 shares being 0.75 % of capital. Contingent liability of Rs. @ crore and pending litigation.",
    "Related party transaction: loan to director of Rs. @ crore and Rs. 12.50 crore. Going concern doubt. Emphasis of matter.",
    "Revenue from operations @ Profit for the period (1,428.27) EBITDA 310.50 (Rs. in crore). Subject to volatile markets.",
    "Order inflow of USD 3 billion; order book of INR 1,250 lakh. CARE A1+ rating. Growth continues, we are confident.",
    "No comments were made. The board meeting is on 05-Jan-2024.",
    "Promoter group: purchase of 1,05,000 shares, 2.4 % of total, on the market. Regulatory and compliance update without deviation.",
    "Revenue from operations (2,310.40) Profit for the period @ EBITDA (88.10), all in million. Input cost and forex weigh on margins.",
    "Sale of 900 shares by a key person, 0.05% after it. Negative outlook; rating downgraded to BBB- by S&P, a sharp fall.",
    "Related party: service contract with an associate for Rs @ crore and a purchase of Rs. 3.75 crore. Contingent liabilities and guarantees given.",
    "ICRA A+ and CARE AA stand. Order backlog Rs. 12,500 crore, order inflow Rs. @ crore in the quarter; FY guidance raised. Key audit matter.",
)


#: Line items made of others, as fixed multiples: arithmetic, not economics. Later ones use earlier ones.
ITEMS = {
    "gross_profit": "revenue - cogs",
    "operating_inc": "gross_profit * 0.6",
    "depreciation": "revenue * 0.03 + inventory * 0.01",
    "ebit": "gross_profit * 0.55",
    "ebitda": "ebit + depreciation",
    "interest_exp": "total_debt * 0.08",
    "sga": "revenue * 0.08 + tax * 0.5",
    "pretax_income": "ebit - interest_exp",
    "current_assets": "receivables + inventory + revenue * 0.1",
    "cash": "revenue * 0.07 + tax * 0.3",
    "ppe_net": "total_assets * 0.3 + inventory * 0.05",
    "payables": "cogs * 0.2",
    "current_liabilities": "payables + total_debt * 0.3",
    "working_capital": "current_assets - current_liabilities",
    "long_term_debt": "total_debt * 0.7",
    "total_liabilities": "total_debt + payables",
    "equity": "total_assets - total_liabilities",
    "retained_earnings": "equity * 0.4",
    "intangibles": "total_assets * 0.08 + tax",
    "capex": "revenue * -0.06 + inventory * -0.02",
    "fcf": "operating_cf + capex",
    "dividends_paid": "net_income * -0.25",
    "shares_outstanding": "1000 + fy - 1992",
    "market_cap": "revenue * 2.5",
    "eps": "net_income / (1000 + fy - 1992)",
    "ppe_gross": "ppe_net * 1.4 + depreciation * 2",
    "goodwill": "total_assets * 0.05 + inventory * 0.02",
    "current_debt": "CASE WHEN fy % 2 = 0 THEN total_debt * 0.28 + tax * 0.1 END",
    "invested_capital": "CASE WHEN fy % 3 = 0 THEN equity + total_debt * 0.9 END",
}


def _fundamentals_sql() -> str:
    sql = """SELECT l_suppkey AS symbol, CAST(year(l_shipdate) AS INTEGER) AS fy, sum(l_extendedprice) AS revenue,
       sum(l_extendedprice*(0.5+l_discount)) AS cogs, sum(l_extendedprice*l_tax) AS tax,
       sum(CASE WHEN l_returnflag='N' THEN l_extendedprice ELSE 0 END) AS receivables,
       sum(CASE WHEN l_returnflag='A' THEN l_extendedprice ELSE 0 END) AS inventory,
       sum(CASE WHEN l_returnflag='R' THEN l_extendedprice ELSE 0 END) AS total_debt,
       sum(l_extendedprice)*1.5 AS total_assets,
       sum(l_extendedprice*(0.4-l_discount-l_tax)) AS net_income,
       sum(l_extendedprice*(0.42-2*l_discount)) AS operating_cf
FROM lineitem GROUP BY 1,2"""
    for name, e in ITEMS.items():
        sql = f"SELECT *, {e} AS {name} FROM ({sql})"
    return sql


SQL = {
    "bars": """SELECT l_suppkey AS symbol, CAST(l_shipdate AS date) AS date,
       arg_min(l_extendedprice/l_quantity, l_orderkey*10+l_linenumber) AS open,
       max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
       arg_max(l_extendedprice/l_quantity, l_orderkey*10+l_linenumber) AS close,
       sum(l_quantity) AS volume
FROM lineitem GROUP BY 1,2""",
    "bench": "SELECT CAST(l_shipdate AS date) AS date, avg(l_extendedprice/l_quantity) AS close FROM lineitem GROUP BY 1",
    "membership": """SELECT s_suppkey AS symbol, n_name AS index_name, r_name AS universe
FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "positions": """SELECT o_custkey AS portfolio, l_suppkey AS symbol, CAST(sum(l_quantity) AS bigint) AS quantity,
       sum(l_extendedprice)/sum(l_quantity) AS avg_cost
FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2""",
    "last_closes": "SELECT symbol, arg_max(close, date) AS last_close FROM bars GROUP BY 1",
    "holdings": """SELECT portfolio, p.symbol, index_name AS sector, quantity, avg_cost, last_close, quantity*avg_cost AS invested,
       quantity*last_close AS present, quantity*last_close - quantity*avg_cost AS pnl
FROM positions p JOIN last_closes l ON p.symbol=l.symbol JOIN membership m ON p.symbol=m.symbol""",
    "chain": """SELECT p_brand AS underlying, CAST(date_trunc('week', l_shipdate) AS date) AS expiry, p_size AS strike,
       CASE l_linestatus WHEN 'F' THEN 'CE' ELSE 'PE' END AS type,
       sum(l_quantity) AS oi, avg(p_retailprice) AS und_price
FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3,4""",
    "monthly": """SELECT 'm_'||o_orderpriority AS indicator, CAST(date_trunc('month', o_orderdate) AS date) AS period,
       sum(o_totalprice) AS value FROM orders GROUP BY 1,2""",
    "fundamentals": _fundamentals_sql(),
    "quarters": """SELECT l_suppkey AS symbol, CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS date) AS quarter_end, sum(l_extendedprice) AS revenue,
       sum(l_extendedprice*(0.4-l_discount-l_tax)) AS net_income, sum(l_extendedprice*(0.5-l_discount-l_tax/2)) AS ebitda FROM lineitem GROUP BY 1,2""",
    "stakes": """SELECT o_custkey AS ticker, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS date) AS as_of,
       (sum(o_totalprice) % 3000.0) / 100 AS pct FROM orders GROUP BY 1,2""",
    "flows": """SELECT CAST(o_orderdate AS date) AS date, c_mktsegment AS sector,
       sum(CASE WHEN o_orderstatus='O' THEN o_totalprice ELSE 0 END) AS buy,
       sum(CASE WHEN o_orderstatus='F' THEN o_totalprice ELSE 0 END) AS sell,
       sum(CASE WHEN o_orderstatus='O' THEN o_totalprice ELSE 0 END) - sum(CASE WHEN o_orderstatus='F' THEN o_totalprice ELSE 0 END) AS net
FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2""",
    "filings": "SELECT o_orderkey AS doc_id, o_custkey AS symbol, CAST(o_orderdate AS date) AS date, format('{:,.2f}', o_totalprice) AS raw, replace(([" + ", ".join(f"'{w}'" for w in WORDINGS) + f"])[CAST(o_orderkey % {len(WORDINGS)} + 1 AS INTEGER)], '@', format('{{:,.2f}}', o_totalprice)) AS text FROM orders",
    "deals": """SELECT CAST(o_orderdate AS date) AS date, o_orderkey AS code, c_name AS client,
       CASE WHEN o_orderstatus='F' THEN 'S' ELSE 'B' END AS side, o_totalprice AS price, o_custkey AS client_id
FROM orders JOIN customer ON o_custkey=c_custkey""",
}
