"""Portfolio operators over all portfolios at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, ratio
from ..shipping import ship_package
from ..sources.store import written
from .merge import numbered
from .series import by_symbol, daily_return, drawdown


def of_portfolio():
    return Window.partitionBy("portfolio")


def totals(holdings: DataFrame) -> DataFrame:
    """Per portfolio: invested, present, pnl, return, winners, losers, win rate, best and worst symbol by return."""
    h = holdings.withColumn("r", ratio("pnl", "invested") * 100)
    return h.groupBy("portfolio").agg(
        F.sum("invested").alias("invested"), F.sum("present").alias("present"), F.sum("pnl").alias("pnl"), (ratio(F.sum("pnl"), F.sum("invested")) * 100).alias("ret"),
        F.count_if(F.col("pnl") > 0).alias("winners"), F.count_if(F.col("pnl") < 0).alias("losers"), (ratio(F.count_if(F.col("pnl") > 0), F.count("*")) * 100).alias("win_rate"),
        F.max_by("symbol", "r").alias("best"), F.min_by("symbol", "r").alias("worst"),
    )


def sector_exposure(holdings: DataFrame) -> DataFrame:
    s = holdings.groupBy("portfolio", "sector").agg(F.count("*").alias("n"), F.sum("invested").alias("invested"), F.sum("present").alias("present"))
    return s.withColumn("weight", ratio("present", F.sum("present").over(of_portfolio())) * 100).withColumn("ret", (ratio("present", "invested") - 1) * 100)


def weights(holdings: DataFrame) -> DataFrame:
    return holdings.withColumn("weight", ratio("present", F.sum("present").over(of_portfolio())))


def collapse(holdings: DataFrame, order: str = "symbol") -> DataFrame:
    """One row a (portfolio, symbol): first attributes in the given order, values summed."""
    return holdings.groupBy("portfolio", "symbol").agg(F.min_by("sector", F.col(order)).alias("sector"), F.sum("quantity").alias("quantity"), F.sum("present").alias("present"))


def concentration(holdings: DataFrame, n: int = 10) -> DataFrame:
    """The n largest positions with running weight; ties go by symbol."""
    by = of_portfolio().orderBy(F.desc("present"), "symbol")
    w = weights(holdings).withColumn("rank", F.row_number().over(by)).withColumn("running", F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return w.where(F.col("rank") <= n)


def beta_table(bars: DataFrame, bench: DataFrame, least: int = 30) -> DataFrame:
    """Per symbol: beta (covariance on common dates over the variance of the whole benchmark), yearly volatility, worst drawdown."""
    r = bars.select("symbol", "date", "close").withColumn("r", daily_return())
    b = bench.withColumn("br", ratio("close", F.lag("close").over(Window.orderBy("date"))) - 1).select("date", "br")  # one row a date
    spread = b.agg(F.var_samp("br").alias("bvar"))
    dd = r.withColumn("dd", drawdown("close", by_symbol()))
    both = dd.join(F.broadcast(b), "date", "left")
    x = both.groupBy("symbol").agg(F.covar_samp("r", "br").alias("cov"), F.count_if(F.col("r").isNotNull() & F.col("br").isNotNull()).alias("n"), F.stddev_samp("r").alias("sd"), (F.min("dd") * 100).alias("max_drawdown"))
    return x.crossJoin(F.broadcast(spread)).where(F.col("n") >= least).select("symbol", ratio("cov", "bvar").alias("beta"), (F.col("sd") * 252**0.5 * 100).alias("volatility"), "max_drawdown", "n")  # one row


#: Positions of one block, about: of portfolios that are neighbours by key, worked on in one task that gets the returns of each symbol they hold once. Tables of fewer are cut into CUTS blocks, of SMALL positions at least.
POSITIONS, SMALL, CUTS = 400_000, 80_000, 64
#: Portfolios of one batch of results.
BATCH = 64


def daily_returns(holdings: DataFrame, bars: DataFrame, block: int | None = None) -> DataFrame:
    """Constant-weight return of each portfolio by date; missing returns count 0. No row is made for a position and a date, none for a portfolio and a date is shuffled."""
    kind = holdings.schema["portfolio"].dataType.simpleString()
    return _by_block(holdings, returns_by_symbol(bars), _returns_as(_rows_by_date), f"portfolio {kind}, date date, r double", block)


def return_spread(holdings: DataFrame, bars: DataFrame, block: int | None = None) -> DataFrame:
    """By date, over the portfolios of daily_returns: how many there are, mean, lowest and highest return. A block gives one row a date, not one a portfolio."""
    sums = _by_block(holdings, returns_by_symbol(bars), _returns_as(_sums_by_date), "date date, n long, known long, total double, low double, high double", block)
    return sums.groupBy("date").agg(F.sum("n").alias("n"), ratio(F.sum("total"), F.sum("known")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def returns_by_symbol(bars: DataFrame) -> DataFrame:
    """symbol, d, r: each symbol's days and daily returns as arrays; missing returns count 0."""
    r = bars.select("symbol", "date", "close").withColumn("r", F.coalesce(daily_return(), F.lit(0.0)))
    series = r.groupBy("symbol").agg(F.collect_list(F.struct(F.unix_date("date").alias("d"), "r")).alias("s"))
    return series.select("symbol", F.col("s.d").alias("d"), F.col("s.r").alias("r"))


def _by_block(holdings: DataFrame, series: DataFrame, rows: Callable, schema: str, block: int | None = None, bench: DataFrame | None = None, positions: int | None = None) -> DataFrame:
    """rows(table) of every block of `block` portfolios, or of about `positions` positions.

    The table has a row (portfolio, symbols, weights) a portfolio, a row of series (symbol, d, r and more) a symbol that one of them holds,
    and one (d, r) of the benchmark's returns. Portfolios are stored with their positions as one row each, and are shuffled so; only the
    keys are numbered, and what a block asks for is told apart where its portfolios lie.
    """
    ship_package(series.sparkSession)
    held = holdings.where("portfolio is not null").groupBy("portfolio").agg(F.collect_list(F.struct("symbol", "present")).alias("h"), F.sum("present").alias("whole"))
    held = written(held.select("portfolio", F.col("h.symbol").alias("symbols"), F.transform("h", lambda x: ratio(x["present"], F.col("whole"))).alias("weights")), "held")
    if block is None:
        n, k = held.agg(F.count("*"), F.sum(F.size("symbols"))).first()
        block = max(1, (positions or min(POSITIONS, max(SMALL, (k or 0) // CUTS))) * n // max(1, k or 0))
    places = numbered(held.select("portfolio"), "place", F.asc("portfolio"))
    first = places.where((F.col("place") - 1) % block == 0).select(F.floor((F.col("place") - 1) / block).alias("block"), F.col("portfolio").alias("first"))
    ends = written(first.withColumn("next", F.lead("first").over(Window.orderBy("block"))), "blocks")  # one row a block
    w = held.join(F.broadcast(ends), (F.col("portfolio") >= F.col("first")) & (F.col("next").isNull() | (F.col("portfolio") < F.col("next")))).drop("first", "next")
    parts = w.unionByName(w.select("block", F.explode("symbols").alias("symbol")).distinct().join(series, "symbol"), allowMissingColumns=True)
    if bench is not None:  # one row a block, of one value a date
        line = bench.agg(F.collect_list(F.struct(F.unix_date("date").alias("d"), F.col("br").alias("r"))).alias("s")).select(F.col("s.d").alias("d"), F.col("s.r").alias("r"))
        parts = parts.unionByName(ends.select("block").crossJoin(F.broadcast(line)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(pa.Table.from_batches(list(batches)))

    return parts.groupBy("block").applyInArrow(run, schema)


def _lines(table: pa.Table, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's list starts, and one more, and the values of all lists one after another."""
    lists = [table[name].combine_chunks() for name in names]
    lengths = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype("int64"), [x.flatten().to_numpy(zero_copy_only=False) for x in lists]


class _Series:
    """symbols, each one's first value and one more, values, and the place of their days among every day there is."""

    def __init__(self, series: pa.Table, value: str = "r") -> None:
        self.symbols = series["symbol"].combine_chunks()
        self.first, (days, self.r) = _lines(series, "d", value)
        low = days.min() if len(days) else 0
        seen = np.zeros((days.max() - low + 1) if len(days) else 0, bool)
        seen[days - low] = True
        self.every = np.flatnonzero(seen) + low
        self.at = (np.cumsum(seen, dtype="int32") - 1)[days - low]


class _Block(_Series):
    """The rows of one block: portfolios with where each one's positions start, and one more; a position's weight and its symbol's place in the series, -1 without one."""

    def __init__(self, table: pa.Table) -> None:
        held = table.filter(pc.is_valid(table["portfolio"]))
        self.series = table.filter(pc.and_(pc.is_valid(table["symbol"]), pc.is_valid(table["d"]))).sort_by("symbol")
        self.line = table.filter(pc.and_(pc.is_null(table["symbol"]), pc.is_valid(table["d"])))
        super().__init__(self.series)
        self.portfolios = held["portfolio"].combine_chunks()
        self.start, (self.weight,) = _lines(held, "weights")
        self.place = pc.fill_null(pc.index_in(held["symbols"].combine_chunks().flatten(), self.symbols), -1).to_numpy(zero_copy_only=False)

    def portfolio(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a portfolio's symbols that have a series."""
        span = slice(self.start[k], self.start[k + 1])
        known = self.place[span] >= 0
        return self.place[span][known], self.weight[span][known]

    def bench(self) -> np.ndarray:
        """The benchmark's return on every day, NaN without one."""
        bench = np.full(len(self.every), np.nan)
        if self.line.num_rows and len(self.every):
            _, (bd, br) = _lines(self.line, "d", "r")
            place = np.minimum(np.searchsorted(self.every, bd), len(self.every) - 1)
            both = self.every[place] == bd
            bench[place[both]] = br[both]
        return bench

    def returns(self) -> Iterator[list[tuple]]:
        """Batches of (portfolio, which days, sum of weight times return by day)."""
        done: list[tuple] = []
        for k in range(len(self.portfolios)):
            mine, weight = self.portfolio(k)
            if not len(mine):
                continue
            spans, has = [slice(self.first[s], self.first[s + 1]) for s in mine], ~np.isnan(weight)
            there = np.concatenate([self.at[s] for s in spans])
            seen = np.bincount(there, minlength=len(self.every)) > 0
            value = np.bincount(there, np.concatenate([self.r[s] * w if k else np.zeros(s.stop - s.start) for s, w, k in zip(spans, weight, has, strict=True)]), len(self.every))
            if not has.all():  # a day of unknown weights only has no return
                some = [self.at[s] for s, k in zip(spans, has, strict=True) if k]
                value[np.bincount(np.concatenate(some), minlength=len(self.every)) == 0 if some else slice(None)] = np.nan
            done.append((k, seen, value))
            if len(done) == BATCH:
                yield done
                done = []
        if done:
            yield done


def _returns_as(rows: Callable) -> Callable:
    """A block's table to rows(block, batches of returns)."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = _Block(table)
        yield from rows(block, block.returns())

    return run


def _rows_by_date(block: _Block, batches: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    for returns in batches:
        owner = np.concatenate([np.full(seen.sum(), k) for k, seen, _ in returns])
        date = np.concatenate([block.every[seen] for _, seen, _ in returns]).astype("int32")
        value = np.concatenate([value[seen] for _, seen, value in returns])
        yield pa.RecordBatch.from_arrays([block.portfolios.take(pa.array(owner)), pa.array(date).view(pa.date32()), pa.array(value, from_pandas=True)], ["portfolio", "date", "r"])


def _sums_by_date(block: _Block, batches: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    n, known, total = np.zeros(len(block.every), "int64"), np.zeros(len(block.every), "int64"), np.zeros(len(block.every))
    low, high = np.full(len(block.every), np.nan), np.full(len(block.every), np.nan)
    for returns in batches:
        for _, seen, value in returns:
            value = np.where(seen, value, np.nan)
            n += seen
            known += ~np.isnan(value)
            total += np.nan_to_num(value, posinf=np.inf, neginf=-np.inf)
            low, high = np.fmin(low, value), np.fmax(high, value)
    date = pa.array(block.every.astype("int32")).view(pa.date32()).filter(pa.array(n > 0))
    yield pa.RecordBatch.from_arrays([date, *[pa.array(x[n > 0], from_pandas=True) for x in (n, known, total, low, high)]], ["date", "n", "known", "total", "low", "high"])


def portfolio_beta(holdings: DataFrame, betas: DataFrame) -> DataFrame:
    """Per portfolio the mean beta of its symbols that have one, by their weights."""
    b = weights(holdings).join(betas.where("beta is not null").select("symbol", "beta"), "symbol")
    return b.groupBy("portfolio").agg(ratio(F.sum(F.col("weight") * F.col("beta")), F.sum("weight")).alias("beta"))


def risk_summary(returns: DataFrame, bench: DataFrame, betas: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Per portfolio, on the dates of benchmark returns: beta, yearly return of portfolio and benchmark and their difference, volatility, Sharpe,
    drawdown, historical VaR of one and five days, parametric VaR, best and worst day. Losses of VaR are positive.

    returns(portfolio, date, r), bench(date, close), betas(portfolio, beta). Yearly returns compound all days to the power of 252 / days;
    Sharpe is the yearly return over the yearly volatility. A return of -1 or less ends at nothing.
    """
    b = bench.select("date", (ratio("close", F.lag("close").over(Window.orderBy("date"))) - 1).alias("br")).where("br is not null")  # one row a date
    w = Window.partitionBy("portfolio").orderBy("date")
    so_far, five = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-4, 0)
    log = lambda c: F.when(F.col(c) > -1, F.log1p(c)).otherwise(float("-inf"))
    x = returns.join(b, "date").withColumn("nav", F.exp(F.sum(log("r")).over(so_far)))
    x = x.withColumn("dd", drawdown("nav", w)).withColumn("r5", F.when(F.count("r").over(five) == 5, F.sum("r").over(five)))
    p, days = 1 - confidence, F.count("*")
    yearly = lambda c: (F.exp(F.sum(log(c)) * 252 / days) - 1) * 100
    out = x.groupBy("portfolio").agg(
        days.alias("days"), yearly("r").alias("annual"), yearly("br").alias("bench_annual"), (F.stddev_samp("r") * 252**0.5 * 100).alias("volatility"), (F.min("dd") * 100).alias("max_drawdown"),
        (-F.percentile("r", p) * 100).alias("var_1d"), (-F.percentile("r5", p) * 100).alias("var_5d"), (1.645 * F.stddev_samp("r") * 100).alias("var_parametric"),
        (F.max("r") * 100).alias("best_day"), (F.min("r") * 100).alias("worst_day"),
    )
    out = out.withColumn("excess", F.col("annual") - F.col("bench_annual")).withColumn("sharpe", ratio("annual", "volatility"))
    return out.join(betas.select("portfolio", "beta"), "portfolio", "left")


#: What holdings_risk finds of one portfolio, in order.
MEASURES = ("days", "annual", "bench_annual", "volatility", "max_drawdown", "var_1d", "var_5d", "var_parametric", "best_day", "worst_day")


def holdings_risk(holdings: DataFrame, bars: DataFrame, bench: DataFrame, betas: DataFrame, invested: float = 1.0, confidence: float = 0.95, block: int | None = None) -> DataFrame:
    """risk_summary of daily_returns times `invested`, found where a portfolio's returns are added up, so that they are not shuffled for it.

    betas(portfolio, beta) as there, or betas(symbol, beta): a portfolio's beta is then that of portfolio_beta, found with the rest.
    """
    b = bench.select("date", (ratio("close", F.lag("close").over(Window.orderBy("date"))) - 1).alias("br")).where("br is not null")  # one row a date
    of_symbols, series = "symbol" in betas.columns, returns_by_symbol(bars)
    series = series.join(betas.select("symbol", "beta"), "symbol", "left") if of_symbols else series.withColumn("beta", F.lit(None).cast("double"))
    names = [*MEASURES, "beta"]

    def rows(block: _Block, batches: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
        bench, beta = block.bench(), block.series["beta"].to_numpy()
        for returns in batches:
            common = [(k, seen & ~np.isnan(bench), value) for k, seen, value in returns]
            found = [(k, *_measures(value[on] * invested, bench[on], confidence), _weighted(beta, *block.portfolio(k))) for k, on, value in common if on.any()]
            columns = [[row[i] for row in found] for i in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([block.portfolios.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.float64(), from_pandas=True) for c in columns[2:]]], ["portfolio", *names])

    kind = holdings.schema["portfolio"].dataType.simpleString()
    out = _by_block(holdings, series, _returns_as(rows), f"portfolio {kind}, days long, " + ", ".join(f"{m} double" for m in names[1:]), block, b)
    out = out.withColumn("excess", F.col("annual") - F.col("bench_annual")).withColumn("sharpe", ratio("annual", "volatility"))
    return out if of_symbols else out.drop("beta").join(betas.select("portfolio", "beta"), "portfolio", "left")


def _weighted(beta: np.ndarray, mine: np.ndarray, weight: np.ndarray) -> float:
    """Mean of the betas there are by their weights, NaN without any."""
    b = beta[mine]
    both = ~np.isnan(b) & ~np.isnan(weight)
    whole = weight[both].sum()
    return (weight[both] * b[both]).sum() / whole if whole != 0 else np.nan


def _measures(r: np.ndarray, br: np.ndarray, confidence: float) -> tuple:
    """MEASURES of one portfolio's returns in order of days and the benchmark's on the same days; what can't be told is NaN."""
    days, p = len(r), (1 - confidence)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        log = lambda x: np.where(x > -1, np.log1p(x), -np.inf)
        yearly = lambda x: (np.exp(log(x).sum() * 252 / days) - 1) * 100
        nav = np.exp(np.cumsum(log(r)))
        peak = np.maximum.accumulate(nav)
        fall = (nav / peak - 1)[peak != 0]
        known = r[~np.isnan(r)]
        sd = known.std(ddof=1) if len(known) > 1 else np.nan
        five = np.lib.stride_tricks.sliding_window_view(r, 5).sum(axis=1) if days >= 5 else r[:0]
        five = five[~np.isnan(five)]
        of = lambda f, x: f(x) if len(x) else np.nan
        var = lambda x: of(lambda v: -np.quantile(v, p) * 100, x)
        return days, yearly(r), yearly(br), sd * 252**0.5 * 100, of(np.min, fall) * 100, var(known), var(five), 1.645 * sd * 100, of(np.max, known) * 100, of(np.min, known) * 100


#: Symbols of one tile; a task multiplies the returns of two tiles. With more than MEETINGS tiles of so many, tiles grow up to MOST symbols, so that a series is sent no more often.
TILE, MEETINGS, MOST = 256, 12, 32_768
#: Symbols of a tile that stand as columns of days at once.
CHUNK = 1024
#: Symbols of one tile where only pairs of one portfolio are asked for, and symbols of a block that are all multiplied with each other.
HELD_TILE, WHOLE = 1024, 4096
#: Symbols of a tile that are multiplied at once, and rows of a batch of strong pairs.
STRIP, ROWS = 256, 100_000


def standardised(bars: DataFrame) -> DataFrame:
    """symbol, d, z: each symbol's days and daily returns as arrays, standardised, so that sums of products don't cancel; a correlation stays what it was."""
    r = bars.select("symbol", "date", "close").withColumn("r", daily_return()).where("r is not null").select("symbol", "date", "r")
    series = r.groupBy("symbol").agg(F.collect_list(F.struct(F.unix_date("date").alias("d"), "r")).alias("s"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    scaled = F.transform("s", lambda x: (x["r"] - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    return series.select("symbol", F.col("s.d").alias("d"), scaled.alias("z"))


def pair_correlations(bars: DataFrame, least: int = 30, tile: int | None = None) -> DataFrame:
    """Correlation of daily returns on common dates of every pair a < b with at least `least` of them: a, b, corr, n.

    Each symbol's returns become one row and symbols are dealt into tiles; two tiles meet in one task, where products of matrices (dates by
    symbols) give counts and sums of a strip of pairs at once. Returns are shuffled once by symbol, then a symbol's row once for every tile;
    no row is made for a pair and a date. The result grows with the square of the symbols.
    """
    ship_package(bars.sparkSession)
    symbols = bars.select("symbol").distinct().count()
    tiles = max(1, -(-symbols // (tile or min(MOST, max(TILE, -(-symbols // MEETINGS))))))
    own = F.pmod(F.xxhash64("symbol"), F.lit(tiles)).cast("int")
    rows = standardised(bars).select("symbol", "d", "z", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    rows = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "symbol", "d", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        yield from _pairs_of_tiles(table.sort_by([("own", "ascending"), ("symbol", "ascending")]), least)

    kind = bars.schema["symbol"].dataType.simpleString()
    return rows.groupBy("i", "j").applyInArrow(run, f"a {kind}, b {kind}, corr double, n long")


def _pairs_of_tiles(table: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one or two tiles, of CHUNK symbols with as many at a time: only so many series stand as columns of days at once."""
    series, own = _Series(table, "z"), table["own"].to_numpy()
    places, one = np.arange(len(own)), table["i"][0] == table["j"][0]
    left = places if one else places[own == table["i"][0].as_py()]
    right = places if one else places[own == table["j"][0].as_py()]
    chunks = lambda p: [p[k : k + CHUNK] for k in range(0, len(p), CHUNK)]
    for n, mine in enumerate(chunks(left)):
        side = _side(series, mine)
        for m, others in enumerate(chunks(right)):
            if one and m < n:
                continue
            sides = [side] if one and m == n else [side, _side(series, others)]
            for begin in range(0, len(mine), STRIP):
                corr, common = _correlations(sides, slice(begin, begin + STRIP), least)
                a, b = np.nonzero(common >= least)
                a_ids, b_ids = series.symbols.take(pa.array(mine[a + begin])), series.symbols.take(pa.array(others[b]))
                less = pc.less(a_ids, b_ids)
                if len(sides) == 1:
                    keep = less.to_numpy(zero_copy_only=False)
                    a, b, a_ids, b_ids = a[keep], b[keep], a_ids.filter(less), b_ids.filter(less)
                else:
                    a_ids, b_ids = pc.if_else(less, a_ids, b_ids), pc.if_else(less, b_ids, a_ids)
                yield pa.RecordBatch.from_arrays([a_ids, b_ids, pa.array(corr[a, b]), pa.array(common[a, b].astype("int64"))], ["a", "b", "corr", "n"])


def _correlations(sides: list[tuple[np.ndarray, np.ndarray]], strip: slice, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Correlations, NaN where one side never changes or days are too few, and common days of a strip of the first tile's symbols with all of the last."""
    (x, kx), (y, ky) = sides[0], sides[-1]
    x, kx = x[:, strip], kx[:, strip]
    n, sx, sy = np.rint(kx.T @ ky), x.T @ ky, kx.T @ y
    vx, vy = n * ((x * x).T @ ky) - sx * sx, n * (kx.T @ (y * y)) - sy * sy
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.clip((n * (x.T @ y) - sx * sy) / np.sqrt(vx * vy), -1, 1)
    corr[(vx <= 1e-12 * n**2) | (vy <= 1e-12 * n**2) | (n < least)] = np.nan
    return corr, n


def held_pairs(correlations: DataFrame, holdings: DataFrame, threshold: float) -> DataFrame:
    """Pairs of symbols held in one portfolio with a correlation at or above the threshold."""
    w = weights(holdings).select("portfolio", "symbol", "weight")
    strong = correlations.where(F.col("corr") >= threshold)
    a = strong.join(w.select("portfolio", F.col("symbol").alias("a"), F.col("weight").alias("wa")), "a")
    return a.join(w.select("portfolio", F.col("symbol").alias("b"), F.col("weight").alias("wb")), ["portfolio", "b"])


def strong_pairs(bars: DataFrame, holdings: DataFrame, threshold: float, least: int = 30, tile: int = HELD_TILE, most: int | None = None, whole: int = WHOLE) -> DataFrame:
    """held_pairs of all correlations, without making other pairs: portfolio, a, b, corr, wa, wb.

    Portfolios go in blocks of about `most` positions to where the series of their symbols are; strong pairs are picked where the
    correlations are, so no weaker pair leaves its task. Up to `whole` symbols of a block are multiplied once for all its portfolios, `tile`
    of them at a time; where its portfolios share fewer, each one's own symbols are.
    """

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block, found, n = _Block(table), [], 0

        def batch() -> pa.RecordBatch:
            who, a, b, c, wa, wb = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([block.portfolios.take(pa.array(who)), block.symbols.take(pa.array(a)), block.symbols.take(pa.array(b)), pa.array(c), pa.array(wa, from_pandas=True), pa.array(wb, from_pandas=True)], ["portfolio", "a", "b", "corr", "wa", "wb"])

        for k, *edges in _strong_in_block(block, threshold, least, tile, whole):
            found.append((np.full(len(edges[0]), k), *edges))
            n += len(edges[0])
            if n >= ROWS:
                yield batch()
                found, n = [], 0
        if found:
            yield batch()

    p, s = (holdings.schema[c].dataType.simpleString() for c in ("portfolio", "symbol"))
    return _by_block(holdings, _standardised_returns(bars), rows, f"portfolio {p}, a {s}, b {s}, corr double, wa double, wb double", positions=most)


def strong_clusters(bars: DataFrame, holdings: DataFrame, threshold: float, least: int = 30, tile: int = HELD_TILE, most: int | None = None, whole: int = WHOLE) -> DataFrame:
    """greedy_clusters of strong_pairs, found where the pairs are, so that no pair is shuffled."""

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block, found = _Block(table), []
        names = block.symbols.to_pylist()
        for k, a, b, corr, wa, wb in _strong_in_block(block, threshold, least, tile, whole):
            wa, wb = ([None if math.isnan(v) else v for v in w.tolist()] for w in (wa, wb))
            found += [(k, *row) for row in _clusters([names[x] for x in a], [names[x] for x in b], corr.tolist(), wa, wb)]
            if len(found) >= ROWS:
                yield _cluster_rows(block.portfolios, found)
                found = []
        if found:
            yield _cluster_rows(block.portfolios, found)

    kind = holdings.schema["portfolio"].dataType.simpleString()
    return _by_block(holdings, _standardised_returns(bars), rows, f"portfolio {kind}, {CLUSTER}", positions=most)


def _standardised_returns(bars: DataFrame) -> DataFrame:
    return standardised(bars).withColumnRenamed("z", "r")


def _strong_in_block(block: _Block, threshold: float, least: int, tile: int, whole: int) -> Iterator[tuple]:
    """portfolio, places a < b, corr, wa, wb of the strong pairs of each portfolio that has any."""
    shared = np.full((len(block.symbols),) * 2, np.nan) if len(block.symbols) <= whole else None
    if shared is not None:
        for i, j, corr in _tiles(block, np.arange(len(block.symbols)), least, tile):
            shared[i, j], shared[j, i] = corr, corr.T
    for k in range(len(block.portfolios)):
        mine, weight = block.portfolio(k)
        order = np.argsort(mine, kind="stable")
        mine, weight = mine[order], weight[order]
        tiles = [(slice(0, len(mine)), slice(0, len(mine)), shared[np.ix_(mine, mine)])] if shared is not None else _tiles(block, mine, least, tile)
        found = []
        for i, j, corr in tiles:
            a, b = np.nonzero(corr >= threshold)
            c, a, b = corr[a, b], a + i.start, b + j.start
            up = mine[a] < mine[b]
            found.append((a[up], b[up], c[up]))
        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ((), (), ())
        if len(a):
            yield k, mine[a], mine[b], c, weight[a], weight[b]


def _tiles(block: _Block, places: np.ndarray, least: int, tile: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Correlations of the series at these places, of `tile` of them with as many at a time, by where they stand; each two tiles once."""
    cuts = [slice(k, min(k + tile, len(places))) for k in range(0, len(places), tile)]
    for n, i in enumerate(cuts):
        side = _side(block, places[i])
        for j in cuts[n:]:
            sides = [side] if i == j else [side, _side(block, places[j])]
            yield i, j, np.concatenate([_correlations(sides, slice(k, k + STRIP), least)[0] for k in range(0, i.stop - i.start, STRIP)])


def _side(block: _Series, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of days by the series at these places and one of where they have values."""
    spans = [slice(block.first[s], block.first[s + 1]) for s in places]
    rows, at = np.repeat(np.arange(len(places)), [s.stop - s.start for s in spans]), np.concatenate([block.at[s] for s in spans])
    x, known = np.zeros((len(block.every), len(places))), np.zeros((len(block.every), len(places)))
    x[at, rows], known[at, rows] = np.concatenate([block.r[s] for s in spans]), 1.0
    return x, known


def greedy_clusters(edges: DataFrame) -> DataFrame:
    """Clusters in which every two symbols have an edge: portfolio, cluster, members, size, weight, avg_corr.

    Symbols come by weight, heaviest first, then by symbol; each joins the first cluster to all of whose members it
    has an edge, or opens one. Clusters of one are left out, the others numbered in the order they were opened.
    edges(portfolio, a, b, corr, wa, wb) holds strong pairs only, so what a portfolio gathers is its own strong symbols; edges are shuffled once.
    """
    ship_package(edges.sparkSession)
    names = ("a", "b", "corr", "wa", "wb")
    own = edges.groupBy("portfolio").agg(F.collect_list(F.struct(*names)).alias("e")).select("portfolio", *[F.col(f"e.{n}").alias(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cluster_rows(batch["portfolio"], [(i, *row) for i in range(batch.num_rows) for row in _clusters(*(batch[n][i].as_py() for n in names))])

    kind = edges.schema["portfolio"].dataType.simpleString()
    return own.mapInArrow(run, f"portfolio {kind}, {CLUSTER}")


#: What is told of a cluster.
CLUSTER = "cluster long, members string, size long, weight double, avg_corr double"


def _cluster_rows(portfolios: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    """Rows of (place of the portfolio, what is told of its cluster)."""
    at, *columns = zip(*found, strict=True) if found else [()] * 6
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([portfolios.take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["portfolio", "cluster", "members", "size", "weight", "avg_corr"])


def _clusters(a: list, b: list, corr: list, wa: list, wb: list) -> list[tuple]:
    """cluster, members, size, weight and avg_corr of one portfolio's clusters."""
    weight = dict(zip(a, wa, strict=True)) | dict(zip(b, wb, strict=True))
    edge = {frozenset(p): c for *p, c in zip(a, b, corr, strict=True)}
    others: dict = {s: set() for s in weight}
    for x, y in zip(a, b, strict=True):
        others[x].add(y)
        others[y].add(x)
    clusters: list[list] = []
    for s in sorted(weight, key=lambda s: (weight[s] is not None, -(weight[s] or 0.0), s)):
        home = next((c for c in clusters if others[s].issuperset(c)), None)
        if home is None:
            clusters.append(home := [])
        home.append(s)
    out = []
    for members in (c for c in clusters if len(c) > 1):
        inside = [edge[frozenset((x, y))] for k, x in enumerate(members) for y in members[k + 1 :]]
        held = [weight[m] for m in members if weight[m] is not None]
        out.append((len(out) + 1, ",".join(map(str, members)), len(members), sum(held) * 100 if held else None, sum(inside) / len(inside)))
    return out


def health(vs_200: Column, vs_100: Column, vs_50: Column, rs_3m: Column, from_cost: Column, down_volume: Column) -> Column:
    """OK, WATCH or ACTION by ordered rules; nulls break no rule."""
    return F.when(vs_200 < 0, "ACTION").when(from_cost <= -25, "ACTION").when((rs_3m < 90) & (vs_100 < 0), "ACTION").when(vs_50 < 0, "WATCH").when(rs_3m < 100, "WATCH").when(down_volume, "WATCH").otherwise("OK")


def pledge_flag(pledged: Column | str, promoter: Column | str) -> Column:
    p, h = F.coalesce(col(pledged), F.lit(0.0)), F.coalesce(col(promoter), F.lit(100.0))
    return F.when((p > 25) | (h < 30), "RED").when((p > 10) | (h < 40), "AMBER").otherwise("OK")


def level_status(price: Column | str, stop: Column | str, target: Column | str, near: float = 3.0) -> Column:
    px, sl, tg = col(price), col(stop), col(target)
    return (
        F.when(px.isNull(), "NO_PRICE").when(sl.isNull() & tg.isNull(), "NO_LEVELS").when(px <= sl, "STOP_HIT").when(px >= tg, "TARGET_HIT")
        .when(ratio(px - sl, px) * 100 <= near, "NEAR_STOP").when(ratio(tg - px, px) * 100 <= near, "NEAR_TARGET").otherwise("OK")
    )


def ordered_by_label(df: DataFrame, label: str, labels: tuple[str, ...], *then) -> DataFrame:
    """Sorted by the labels' own order; unknown labels last."""
    return df.withColumn("label_order", label_order(label, labels)).orderBy("label_order", *then)


def label_order(label: str, labels: tuple[str, ...]) -> Column:
    """The label's place in the given order; unknown labels last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, labels)), F.col(label)), F.lit(0).cast("long")), F.lit(len(labels) + 1))
