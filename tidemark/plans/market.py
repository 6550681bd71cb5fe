"""Queries over price series, financials and the features made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import ewm_last, guarded_corr, macd_last, percent_change, q4
from tidemark.operators import fundamentals, prices, recurrences, training
from tidemark.plans.catalogue import query
from tidemark.sources import entities
from tidemark.sources.store import stored

# --- SQL pieces of the oracles ---

TRADES = """trades AS (SELECT l_suppkey code, l_shipdate::DATE AS date, (l_orderkey * 100 + l_linenumber) * 10000000 + l_partkey seq,
  floor(100.0::DOUBLE * l_extendedprice / l_quantity + 0.5::DOUBLE) price, l_quantity quantity FROM lineitem)"""
OHLCV = "arg_min(price, seq) open, max(price) high, min(price) low, arg_max(price, seq) AS close, sum(quantity) volume"
BARS = f"{TRADES}, bars AS (SELECT code, date, {OHLCV} FROM trades GROUP BY code, date)"
INDEX = f"idx AS (SELECT date, {OHLCV} FROM trades GROUP BY date)"
GROWTH = f"""grow AS (SELECT date, {OHLCV} FROM trades WHERE code IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') GROUP BY date)"""
W = "(PARTITION BY code ORDER BY date)"


def frame(n: int) -> str:
    return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {n if least is None else least} THEN {f}({x}) OVER {frame(n)} END"


def sq4(x: str) -> str:
    return f"floor(({x}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


FIRST = f"""a AS (SELECT *, (close / nullif(lag(close) OVER {W}, 0) - 1) * 100 AS change,
  greatest(coalesce(close - lag(close) OVER {W}, 0), 0) gain, greatest(coalesce(lag(close) OVER {W} - close, 0), 0) loss,
  greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) tr,
  greatest(coalesce(high - lag(high) OVER {W}, 0), 0) up, greatest(coalesce(lag(low) OVER {W} - low, 0), 0) down FROM bars)"""
SECOND = f"""b AS (SELECT *, {roll("avg", "close", 50, 1)} ma50, {roll("avg", "close", 200, 1)} ma200, {roll("avg", "gain", 14)} mg, {roll("avg", "loss", 14)} ml,
  {roll("avg", "tr", 14, 1)} atr14, {roll("avg", "close", 20)} mean20, {roll("stddev_samp", "close", 20)} std20,
  100 * (({roll("max", "high", 14)}) - close) / nullif(({roll("max", "high", 14)}) - ({roll("min", "low", 14)}), 0) pr14,
  ({roll("sum", "up", 14)}) / nullif(({roll("avg", "tr", 14)}), 0) * 100 pdi, ({roll("sum", "down", 14)}) / nullif(({roll("avg", "tr", 14)}), 0) * 100 ndi FROM a)"""
THIRD = f"""c AS (SELECT *, CASE WHEN ml > 0 THEN 100 - 100 / (1 + mg / ml) WHEN mg > 0 THEN 100 END rsi14, mean20 + 2 * std20 AS upper, mean20 - 2 * std20 AS lower,
  abs(pdi - ndi) / nullif(pdi + ndi, 0) dx FROM b), d AS (SELECT *, ({roll("avg", "dx", 14)}) * 100 adx14 FROM c)"""
INDICATORS = f"{BARS}, {FIRST}, {SECOND}, {THIRD}"


def indicator_sql(*columns: str) -> str:
    return f"WITH {INDICATORS} SELECT code, date, {', '.join(f'{sq4(c)} AS {c}' for c in columns)} FROM d"


def indicators(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    found = prices.with_indicators(entities.bars(spark, sf_dir))
    return found.select("code", "date", *(q4(F.col(c)).alias(c) for c in columns))


# --- bars and indicators ---


@query(f"WITH {BARS} SELECT * FROM bars")
def bars_daily(spark, sf_dir):
    return entities.bars(spark, sf_dir)


@query(f"WITH {TRADES}, {INDEX} SELECT * FROM idx")
def bars_index(spark, sf_dir):
    return entities.index_bars(spark, sf_dir)


@query(f"WITH {TRADES}, {GROWTH} SELECT * FROM grow")
def bars_growth(spark, sf_dir):
    return entities.growth_bars(spark, sf_dir)


@query(indicator_sql("change"))
def pct_change(spark, sf_dir):
    return indicators(spark, sf_dir, "change")


@query(indicator_sql("ma50", "ma200"))
def ma50_ma200(spark, sf_dir):
    return indicators(spark, sf_dir, "ma50", "ma200")


@query(indicator_sql("rsi14"))
def rsi14(spark, sf_dir):
    return indicators(spark, sf_dir, "rsi14")


@query(indicator_sql("tr"))
def true_range(spark, sf_dir):
    return indicators(spark, sf_dir, "tr")


@query(indicator_sql("atr14"))
def atr14(spark, sf_dir):
    return indicators(spark, sf_dir, "atr14")


@query(indicator_sql("upper", "lower"))
def bollinger20(spark, sf_dir):
    return indicators(spark, sf_dir, "upper", "lower")


@query(indicator_sql("pr14"))
def percent_r14(spark, sf_dir):
    return indicators(spark, sf_dir, "pr14")


@query(indicator_sql("up", "down", "pdi", "ndi"))
def directional_movement(spark, sf_dir):
    return indicators(spark, sf_dir, "up", "down", "pdi", "ndi")


@query(indicator_sql("adx14"))
def adx14(spark, sf_dir):
    return indicators(spark, sf_dir, "adx14")


LATEST = ("rsi14", "ma50", "ma200", "upper", "lower", "pr14", "adx14")


@query(f"WITH {INDICATORS} SELECT code, max(date) AS date, {', '.join(f'{sq4(f"arg_max({c}, date) FILTER ({c} IS NOT NULL)")} AS {c}' for c in LATEST)}, {sq4('avg(atr14)')} AS atr FROM d GROUP BY code")
def latest_signals(spark, sf_dir):
    """Each code's last value of every indicator that has one, and its mean ATR."""
    found = prices.with_indicators(entities.bars(spark, sf_dir))
    last = [q4(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))).alias(c) for c in LATEST]
    return found.groupBy("code").agg(F.max("date").alias("date"), *last, q4(F.avg("atr14")).alias("atr"))


CLOSES = "closes AS (SELECT code, list(close ORDER BY date) v FROM bars GROUP BY code)"


@query(f"WITH {BARS}, {CLOSES} SELECT code, {sq4('list_reduce(v, lambda s, x: s * (1 - 2.0::DOUBLE / 13) + x * (2.0::DOUBLE / 13))')} AS ewm12 FROM closes")
def ewm12_last(spark, sf_dir):
    return prices.closes(entities.bars(spark, sf_dir)).select("code", q4(ewm_last(F.col("closes"), 12)).alias("ewm12"))


MACD_SQL = f"""WITH {BARS}, n AS (SELECT code, date, close, row_number() OVER {W} rn, count(*) OVER (PARTITION BY code) k FROM bars),
r AS (WITH RECURSIVE t AS (SELECT code, rn, k, close AS f, close AS s, 0.0::DOUBLE AS g FROM n WHERE rn = 1
  UNION ALL SELECT n.code, n.rn, n.k, t.f * (1 - 2.0::DOUBLE / 13) + n.close * (2.0::DOUBLE / 13), t.s * (1 - 2.0::DOUBLE / 27) + n.close * (2.0::DOUBLE / 27),
    t.g * (1 - 2.0::DOUBLE / 10) + ((t.f * (1 - 2.0::DOUBLE / 13) + n.close * (2.0::DOUBLE / 13)) - (t.s * (1 - 2.0::DOUBLE / 27) + n.close * (2.0::DOUBLE / 27))) * (2.0::DOUBLE / 10)
  FROM t JOIN n ON n.code = t.code AND n.rn = t.rn + 1) SELECT * FROM t WHERE rn = k)
SELECT code, {sq4("f - s")} AS macd, {sq4("g")} AS signal FROM r"""


@query(MACD_SQL)
def macd_signal(spark, sf_dir):
    m = F.col("m")
    return prices.closes(entities.bars(spark, sf_dir)).select("code", macd_last(F.col("closes")).alias("m")).select("code", q4(m["fast"] - m["slow"]).alias("macd"), q4(m["signal"]).alias("signal"))


ROLL14 = f"WITH {BARS} SELECT code, date, {sq4(roll('avg', 'close', 14))} AS mean14, {roll('max', 'high', 14)} AS high14, {roll('min', 'low', 14)} AS low14, {roll('sum', 'volume', 14)} AS volume14 FROM bars"


@query(ROLL14)
def rolling_full14(spark, sf_dir):
    from tidemark.functions.indicators import rolling

    w = prices.series()
    r = lambda f, c: rolling(f, F.col(c), w, 14)
    return entities.bars(spark, sf_dir).select("code", "date", q4(r(F.avg, "close")).alias("mean14"), r(F.max, "high").alias("high14"), r(F.min, "low").alias("low14"), r(F.sum, "volume").alias("volume14"))


CORR = "coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0)"
CHANGES = f"""s AS (SELECT code, date, row_number() OVER {W} ordinal, (close / nullif(lag(close) OVER {W}, 0) - 1) * 100 x FROM bars),
i AS (SELECT date, row_number() OVER (ORDER BY date) ordinal, (close / nullif(lag(close) OVER (ORDER BY date), 0) - 1) * 100 y FROM idx)"""


def corr_sql(by: str) -> str:
    return f"WITH {BARS}, {INDEX}, {CHANGES} SELECT code, floor({CORR} * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS corr FROM (SELECT code, CASE WHEN y IS NOT NULL THEN x END x, CASE WHEN x IS NOT NULL THEN y END y FROM s JOIN i USING ({by})) GROUP BY code"


def index_corr(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    stock = entities.bars(spark, sf_dir).withColumn("change", percent_change("close", prices.series()))
    index = entities.index_bars(spark, sf_dir).withColumn("change", percent_change("close", Window.orderBy("date")))  # one row a day
    return prices.aligned_changes(stock, index, by).groupBy("code").agg(q4(guarded_corr("change", "index_change")).alias("corr"))


@query(corr_sql("date"))
def index_corr_date(spark, sf_dir):
    return index_corr(spark, sf_dir, "date")


@query(corr_sql("ordinal"))
def index_corr_ordinal(spark, sf_dir):
    return index_corr(spark, sf_dir, "ordinal")


# --- targets ---

RATES = ", ".join(f"({'close - open' if d == 0 else f'lead(close, {d}) OVER {W} - close'}) / nullif(close, 0) * 100 AS rate_{d}" for d in prices.HORIZONS)


@query(f"WITH {BARS}, r AS (SELECT code, date, {RATES} FROM bars) SELECT code, date, {', '.join(f'{sq4(f"rate_{d}")} AS rate_{d}' for d in prices.HORIZONS)} FROM r")
def change_rates(spark, sf_dir):
    return prices.change_rates(entities.bars(spark, sf_dir)).select("code", "date", *(q4(F.col(f"rate_{d}")).alias(f"rate_{d}") for d in prices.HORIZONS))


CARRIED = ", ".join(
    f"{sq4('coalesce(' + ', '.join(f'rate_{d}' for d in reversed(prices.HORIZONS[: k + 1])) + ', -9999)')} AS target_{prices.HORIZONS[k]}" for k in range(len(prices.HORIZONS))
)


@query(f"WITH {BARS}, r AS (SELECT code, date, {RATES} FROM bars) SELECT code, date, {CARRIED} FROM r")
def target_vector(spark, sf_dir):
    rates = prices.change_rates(entities.bars(spark, sf_dir)).select("code", "date", *(f"rate_{d}" for d in prices.HORIZONS))
    vector = rates.select("code", "date", *prices.carried())
    return vector.select("code", "date", *(q4(F.col(f"target_{d}")).alias(f"target_{d}") for d in prices.HORIZONS))


@query(f"WITH {BARS}, r AS (SELECT code, date, close, {RATES} FROM bars) SELECT code, date, close::BIGINT || ':' || floor(rate_3 * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS pair FROM r WHERE rate_3 IS NOT NULL")
def close_pairs(spark, sf_dir):
    """Each bar's close and its forward rate of three bars, in hundredths, as `close:rate`."""
    text = lambda c: c.cast("bigint").cast("string")
    rates = prices.change_rates(entities.bars(spark, sf_dir), (3,)).where("rate_3 is not null")
    return rates.select("code", "date", F.concat_ws(":", text(F.col("close")), text(F.floor(F.col("rate_3") * 100.0 + 0.5))).alias("pair"))


# --- financials ---

FIN = """fin0 AS (SELECT l_suppkey code, year(l_shipdate) y, sum(floor(100.0::DOUBLE * l_extendedprice + 0.5::DOUBLE))::BIGINT assets,
  sum(floor(100.0::DOUBLE * l_extendedprice + 0.5::DOUBLE) - floor(100.0::DOUBLE * l_extendedprice * (1.0::DOUBLE - l_discount) + 0.5::DOUBLE))::BIGINT profit,
  sum(l_quantity)::BIGINT shares FROM lineitem GROUP BY 1, 2),
fin1 AS (SELECT *, floor(assets / 2)::BIGINT equity FROM fin0),
fin AS (SELECT code, y || '/03' AS year, assets::VARCHAR assets, equity::VARCHAR equity, profit::VARCHAR profit,
  CASE WHEN code % 11 = 0 THEN '-' ELSE floor(equity::DOUBLE / shares)::BIGINT::VARCHAR END bps, CASE WHEN code % 7 = 0 THEN '-' ELSE floor(profit::DOUBLE / shares)::BIGINT::VARCHAR END eps,
  CASE WHEN code % 5 = 0 THEN '-' ELSE floor(100.0::DOUBLE * profit / equity)::BIGINT::VARCHAR END roe, CASE WHEN code % 3 = 0 THEN '-' ELSE floor(100.0::DOUBLE * profit / assets)::BIGINT::VARCHAR END roa FROM fin1)"""
TYPED = """typed AS (SELECT code, last_day(strptime(year || '/01', '%Y/%m/%d')::DATE) fiscal_end, TRY_CAST(assets AS DOUBLE) assets, TRY_CAST(equity AS DOUBLE) equity,
  TRY_CAST(profit AS DOUBLE) profit, TRY_CAST(bps AS DOUBLE) bps, TRY_CAST(eps AS DOUBLE) eps, TRY_CAST(roe AS DOUBLE) roe, TRY_CAST(roa AS DOUBLE) roa FROM fin)"""
DISC = "disc AS (SELECT o_orderkey id, o_custkey % (SELECT count(*) FROM supplier) code, o_orderdate::DATE AS date, o_orderpriority title, o_orderstatus place, o_totalprice total FROM orders)"
EVENTS = "ev AS (SELECT id, code, date FROM disc)"


def as_of_sql(sign: str) -> str:
    return f"found AS (SELECT id, code, date, f.* EXCLUDE (code) FROM ev JOIN (SELECT * FROM typed) f USING (code) WHERE fiscal_end {sign} date QUALIFY row_number() OVER (PARTITION BY id ORDER BY fiscal_end DESC) = 1)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.disclosures(spark, sf_dir).select("id", "code", "date")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fundamentals.typed(entities.financials(spark, sf_dir))


@query(f"WITH {FIN}, {TYPED} SELECT * FROM typed")
def safe_cast(spark, sf_dir):
    return statements(spark, sf_dir)


@query(f"WITH {FIN}, {TYPED}, {DISC}, {EVENTS}, {as_of_sql('<=')} SELECT * FROM found")
def asof_financials_incl(spark, sf_dir):
    return fundamentals.as_of(events(spark, sf_dir), statements(spark, sf_dir))


@query(f"WITH {FIN}, {TYPED}, {DISC}, {EVENTS}, {as_of_sql('<')} SELECT * FROM found")
def asof_financials_strict(spark, sf_dir):
    return fundamentals.as_of(events(spark, sf_dir), statements(spark, sf_dir), inclusive=False)


def imputed_sql(source: str) -> str:
    return f"""sh AS (SELECT *, equity / nullif(bps, 0) shares FROM {source}),
imp AS (SELECT * EXCLUDE (eps, roe, roa), coalesce(eps, CASE WHEN shares > 0 THEN profit / shares END) eps, coalesce(roe, CASE WHEN equity > 0 THEN 100 * profit / equity END) roe,
  coalesce(roa, CASE WHEN assets > 0 THEN 100 * profit / assets END) roa FROM sh)"""


@query(f"WITH {FIN}, {TYPED}, {imputed_sql('typed')} SELECT code, fiscal_end, {', '.join(f'{sq4(c)} AS {c}' for c in ('shares', 'eps', 'roe', 'roa'))} FROM imp")
def impute_eps_roe_roa(spark, sf_dir):
    return fundamentals.imputed(statements(spark, sf_dir)).select("code", "fiscal_end", *(q4(F.col(c)).alias(c) for c in ("shares", "eps", "roe", "roa")))


RATIOS = f"""priced AS (SELECT imp.*, b.open AS price FROM imp JOIN bars b USING (code, date)),
ratio AS (SELECT *, CASE WHEN eps > 0 THEN price / eps END per, CASE WHEN bps > 0 THEN price / bps END pbr, price * shares cap FROM priced)"""
RATIO_SQL = f"WITH {BARS}, {FIN}, {TYPED}, {DISC}, {EVENTS}, {as_of_sql('<=')}, {imputed_sql('found')}, {RATIOS}"


@query(f"{RATIO_SQL} SELECT id, {', '.join(f'{sq4(c)} AS {c}' for c in ('eps', 'roe', 'per', 'pbr', 'cap'))}, {sq4('ln(1 + cap)')} AS cap_log FROM ratio")
def fundamental_ratios(spark, sf_dir):
    """Disclosures on a trading day with the ratios of their code's latest statement at that day's open."""
    return training.ratios_at(events(spark, sf_dir), statements(spark, sf_dir), entities.bars(spark, sf_dir)).select("id", *(q4(F.col(c)).alias(c) for c in ("eps", "roe", "per", "pbr", "cap", "cap_log")))


@query(f"WITH {BARS}, {FIN}, {TYPED}, sh AS (SELECT code, fiscal_end, equity / nullif(bps, 0) shares FROM typed), l AS (SELECT code, arg_max(close, date) price FROM bars GROUP BY code) SELECT code, fiscal_end, {sq4('price * shares')} AS cap FROM sh JOIN l USING (code)")
def market_cap(spark, sf_dir):
    last = entities.bars(spark, sf_dir).groupBy("code").agg(F.max_by("close", "date").alias("price"))
    return fundamentals.ratios(fundamentals.imputed(statements(spark, sf_dir)).join(last, "code")).select("code", "fiscal_end", q4(F.col("cap")).alias("cap"))


@query(f"""WITH {BARS}, {FIN}, {DISC}, {EVENTS},
told AS (SELECT code, last_day(strptime(year || '/01', '%Y/%m/%d')::DATE) + (40 + code % 20)::INTEGER AS disclosed, replace(eps, '-', '') AS eps, replace(bps, '-', '') AS bps, equity FROM fin),
x AS (SELECT id, open AS price, eps, bps, equity, 1000000 - code AS s FROM ev JOIN told USING (code) JOIN bars USING (code, date) WHERE disclosed < date QUALIFY row_number() OVER (PARTITION BY id ORDER BY disclosed DESC) = 1),
y AS (SELECT id, price, s, TRY_CAST(eps AS DOUBLE) AS e, CASE WHEN bps = '' THEN TRY_CAST(equity AS DOUBLE) / nullif(s, 0) ELSE TRY_CAST(bps AS DOUBLE) END AS b FROM x)
SELECT id, {sq4("e")} AS eps, {sq4("b")} AS bps, {sq4("price / nullif(e, 0)")} AS per, {sq4("price / nullif(b, 0)")} AS pbr, {sq4("price * s")} AS cap FROM y""")
def disclosed_statements(spark, sf_dir):
    """Disclosures on a trading day with the ratios of the last statement that their code had disclosed before it, at the day's open."""
    fin = entities.financials(spark, sf_dir)
    blank = lambda c: F.replace(F.col(c), F.lit("-"), F.lit("")).alias(c)
    end = F.last_day(F.to_date("year", "yyyy/MM"))
    told = fin.select("code", F.date_add(end, (40 + F.col("code") % 20).cast("int")).alias("disclosed"), blank("eps"), blank("bps"), "equity", F.lit("1000000").alias("total_shares"), F.col("code").cast("string").alias("treasury_shares"))
    opening = entities.bars(spark, sf_dir).select("code", "date", F.col("open").alias("price"))
    found = fundamentals.as_of(events(spark, sf_dir), told, inclusive=False, at="disclosed").join(opening, ["code", "date"])
    return fundamentals.statement_ratios(found).select("id", *(q4(F.col(c)).alias(c) for c in ("eps", "bps", "per", "pbr", "cap")))


# --- windows around disclosures ---


@query(f"WITH {BARS}, {DISC} SELECT id, count(*) AS n, min(b.date) AS first_day, max(b.date) AS last_day, sum(volume) AS volume FROM disc JOIN bars b ON b.code = disc.code AND b.date >= disc.date - 200 AND b.date < disc.date + 1 GROUP BY id")
def past_window_range_join(spark, sf_dir):
    found = prices.around(entities.bars(spark, sf_dir), events(spark, sf_dir), F.date_sub("date", 200), F.date_add("date", 1))
    return found.groupBy("id").agg(F.count("*").alias("n"), F.min("bar_date").alias("first_day"), F.max("bar_date").alias("last_day"), F.sum("volume").alias("volume"))


@query(f"WITH {BARS}, {DISC} SELECT id, count(*) AS n, min(b.date) AS first_day, max(b.date) AS last_day FROM disc JOIN bars b ON b.code = disc.code AND b.date >= disc.date AND b.date < disc.date + INTERVAL 3 MONTH GROUP BY id")
def forward_window_range_join(spark, sf_dir):
    found = prices.around(entities.bars(spark, sf_dir), events(spark, sf_dir), F.col("date"), F.add_months("date", 3), 92)
    return found.groupBy("id").agg(F.count("*").alias("n"), F.min("bar_date").alias("first_day"), F.max("bar_date").alias("last_day"))


@query(f"WITH {BARS}, {DISC} SELECT id, date_diff('day', disc.date, b.date) AS days FROM disc JOIN bars b ON b.code = disc.code WHERE date_diff('day', disc.date, b.date) BETWEEN -200 AND 200")
def day_distance(spark, sf_dir):
    days = F.date_diff("bar_date", "date")
    found = prices.around(entities.bars(spark, sf_dir), events(spark, sf_dir), F.date_sub("date", 200), F.date_add("date", 201), 401)
    return found.select("id", days.cast("bigint").alias("days"))


@query(f"WITH {BARS}, {INDEX}, c AS (SELECT DISTINCT code FROM bars) SELECT code, idx.date, close FROM c, idx WHERE (code, idx.date) IN (SELECT (code, date) FROM bars)")
def day_offset_semi(spark, sf_dir):
    """Per code the index rows of its days; a code has a day once, so the join is a semi-join for each code."""
    own = entities.bars(spark, sf_dir).select("code", "date")
    return entities.index_bars(spark, sf_dir).join(own, "date").select("code", "date", "close")


# --- the training set ---

EVER = "(PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)"
NEAR = "(PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL 200 DAY PRECEDING AND CURRENT ROW)"
MACD_ROWS = f"""n AS (SELECT code, date, close, row_number() OVER {W} rn FROM bars),
m AS (WITH RECURSIVE t AS (SELECT code, date, rn, close AS f, close AS s, 0.0::DOUBLE AS g FROM n WHERE rn = 1
  UNION ALL SELECT n.code, n.date, n.rn, t.f * (1 - 2.0::DOUBLE / 13) + n.close * (2.0::DOUBLE / 13), t.s * (1 - 2.0::DOUBLE / 27) + n.close * (2.0::DOUBLE / 27),
    t.g * (1 - 2.0::DOUBLE / 10) + ((t.f * (1 - 2.0::DOUBLE / 13) + n.close * (2.0::DOUBLE / 13)) - (t.s * (1 - 2.0::DOUBLE / 27) + n.close * (2.0::DOUBLE / 27))) * (2.0::DOUBLE / 10)
  FROM t JOIN n ON n.code = t.code AND n.rn = t.rn + 1) SELECT code, date, f - s AS macd, g AS signal FROM t)"""
LASTS = ", ".join([f"last_value({c} IGNORE NULLS) OVER {NEAR} {c}" for c in training.LAST_NEAR] + [f"last_value({c} IGNORE NULLS) OVER {EVER} {c}" for c in training.LAST_EVER])
def features_of(win: str) -> str:
    """The features as the table `raw`. win: the bars of each event's window (id, change, atr14) with the changes of both indices, y and z."""
    return f"""WITH {INDICATORS}, {MACD_ROWS}, {INDEX}, {GROWTH}, {FIN}, {TYPED}, {DISC}, {EVENTS}, {as_of_sql('<=')}, {imputed_sql('found')}, {RATIOS},
l AS (SELECT code, date, macd, signal, {LASTS} FROM d JOIN m USING (code, date)),
ic AS (SELECT date, (close / nullif(lag(close) OVER (ORDER BY date), 0) - 1) * 100 y FROM idx), gc AS (SELECT date, (close / nullif(lag(close) OVER (ORDER BY date), 0) - 1) * 100 z FROM grow),
{win}agg AS (SELECT id, avg(atr14) atr,
  covar_pop(change, y) FILTER (change IS NOT NULL AND y IS NOT NULL) / nullif(stddev_pop(change) FILTER (y IS NOT NULL) * stddev_pop(y) FILTER (change IS NOT NULL), 0) index_corr,
  covar_pop(change, z) FILTER (change IS NOT NULL AND z IS NOT NULL) / nullif(stddev_pop(change) FILTER (z IS NOT NULL) * stddev_pop(z) FILTER (change IS NOT NULL), 0) growth_corr FROM win GROUP BY id),
raw AS (SELECT * FROM (SELECT id, code, date, eps, roe, per, pbr, ln(1 + cap) cap_log FROM ratio) JOIN agg USING (id) JOIN l USING (code, date))"""


def feature_sql(win: str) -> str:
    return f"""{features_of(win)}
SELECT id, {", ".join(f"coalesce({sq4(c)}, 0) AS {c}" for c in training.FEATURES if c != "atr")}, floor(atr * 100.0::DOUBLE + 0.3217::DOUBLE) / 100.0::DOUBLE AS atr FROM raw"""


def cut(c: Column) -> Column:
    """Two decimals, cut where sums of another order hardly fall."""
    return F.floor(c * 100.0 + 0.3217) / 100.0


def cut_sql(x: str) -> str:
    return f"floor(({x}) * 100.0::DOUBLE + 0.3217::DOUBLE) / 100.0::DOUBLE"


BY_DATE = """win AS (SELECT e.id, d.change, d.atr14, ic.y, gc.z FROM ratio e JOIN d ON d.code = e.code AND d.date >= e.date - 200 AND d.date < e.date + 1
  LEFT JOIN ic ON ic.date = d.date LEFT JOIN gc ON gc.date = d.date),"""
BY_ORDINAL = """bw AS (SELECT e.id, e.date, d.date bar_date, d.change, d.atr14, row_number() OVER (PARTITION BY e.id ORDER BY d.date) place FROM ratio e JOIN d ON d.code = e.code AND d.date >= e.date - 200 AND d.date < e.date + 1),
ind AS (SELECT coalesce(ic.date, gc.date) AS date, y, z, row_number() OVER (ORDER BY coalesce(ic.date, gc.date)) ordinal FROM ic FULL JOIN gc ON ic.date = gc.date),
be AS (SELECT x.date, min(ordinal) AS first FROM (SELECT DISTINCT date FROM ratio) x JOIN ind ON ind.date >= x.date - 200 GROUP BY x.date),
win AS (SELECT bw.id, bw.change, bw.atr14, CASE WHEN h.id IS NOT NULL THEN y END y, CASE WHEN h.id IS NOT NULL THEN z END z FROM bw LEFT JOIN be USING (date) LEFT JOIN ind ON ordinal = first + place - 1
  LEFT JOIN (SELECT id, bar_date FROM bw) h ON h.id = bw.id AND h.bar_date = ind.date),"""


def feature_rows(spark: SparkSession, sf_dir: str, align: str = "date") -> tuple[DataFrame, DataFrame]:
    """The features of all disclosures, and the bars that they're made of: one pass over the trades for all bars, stored, and one for the statements."""
    placed = stored(entities.placed_bars(spark, sf_dir), "bars")
    growth = entities.merged_bars(placed.join(entities.growth_codes(spark, sf_dir), "code", "left_semi"))
    return training.features(events(spark, sf_dir), statements(spark, sf_dir), placed.drop("first", "last"), entities.merged_bars(placed), growth, align), placed


def shown_features(found: DataFrame) -> DataFrame:
    """Features with missing ones 0. A mean of means often ends in halves: it's cut where no such mean falls."""
    shown = [F.coalesce(q4(F.col(c)), F.lit(0.0)).alias(c) for c in training.FEATURES if c != "atr"]
    return found.select("id", *shown, (F.floor(F.col("atr") * 100.0 + 0.3217) / 100.0).alias("atr"))


@query(feature_sql(BY_DATE))
def feature_vectors(spark, sf_dir):
    """The network's 17 features of every disclosure."""
    return shown_features(feature_rows(spark, sf_dir)[0])


@query(feature_sql(BY_ORDINAL))
def feature_vectors_ordinal(spark, sf_dir):
    """The same with bars and index days paired by their place in the event's days."""
    return shown_features(feature_rows(spark, sf_dir, "ordinal")[0])


@query(f"WITH {BARS}, {MACD_ROWS} SELECT code, date, {sq4('macd')} AS macd, {sq4('signal')} AS signal FROM m")
def macd_series(spark, sf_dir):
    """MACD and its signal at every bar."""
    return recurrences.with_macd(entities.bars(spark, sf_dir)).select("code", "date", q4(F.col("macd")).alias("macd"), q4(F.col("signal")).alias("signal"))


MEANS_SQL = f"""WITH {BARS}, n AS (SELECT code, date, close, row_number() OVER {W} rn FROM bars),
m AS (WITH RECURSIVE t AS (SELECT code, date, rn, close AS a, close AS b, close AS c FROM n WHERE rn = 1
  UNION ALL SELECT n.code, n.date, n.rn, t.a * (1 - 2.0::DOUBLE / 10) + n.close * (2.0::DOUBLE / 10), t.b * (1 - 2.0::DOUBLE / 13) + n.close * (2.0::DOUBLE / 13), t.c * (1 - 2.0::DOUBLE / 27) + n.close * (2.0::DOUBLE / 27)
  FROM t JOIN n ON n.code = t.code AND n.rn = t.rn + 1) SELECT * FROM t)
SELECT code, date, {", ".join(f"floor({c} * 100.0::DOUBLE + 0.3217::DOUBLE) / 100.0::DOUBLE AS {n}" for c, n in (("a", "ewm9"), ("b", "ewm12"), ("c", "ewm26")))} FROM m"""


@query(MEANS_SQL)
def ewma_series(spark, sf_dir):
    """The exponentially weighted means of the close at every bar."""
    found = recurrences.with_means(entities.bars(spark, sf_dir).select("code", "date", "close"), "close", {"ewm9": 9, "ewm12": 12, "ewm26": 26})
    # means of some hundred thousand are cut at cents, where sums in another order hardly differ
    return found.select("code", "date", *((F.floor(F.col(c) * 100.0 + 0.3217) / 100.0).alias(c) for c in ("ewm9", "ewm12", "ewm26")))


@query()
def work_set(spark, sf_dir):
    """id, features (an array in fixed order), targets and document of every disclosure that has them all."""
    feats, bars = feature_rows(spark, sf_dir)
    return training.work_set(feats, events(spark, sf_dir), bars.drop("first", "last"), event_texts(spark, sf_dir))


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and document of every disclosure that has one: the document of its own number."""
    texts = entities.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    return texts.join(entities.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi")


@query(f"""{features_of(BY_DATE)}, r AS (SELECT code, date, {RATES} FROM bars),
t AS (SELECT code, date, {", ".join(f"coalesce({', '.join(f'rate_{d}' for d in reversed(prices.HORIZONS[: k + 1]))}, -9999) AS target_{prices.HORIZONS[k]}" for k in range(len(prices.HORIZONS)))} FROM r)
SELECT id, {", ".join(f"{cut_sql(f'coalesce({c}, 0)')} AS {c}" for c in training.FEATURES)}, {", ".join(f"{cut_sql(f'target_{d}')} AS target_{d}" for d in prices.HORIZONS)}, text AS document
FROM raw JOIN t USING (code, date) JOIN documents ON doc_id = id WHERE text IS NOT NULL AND {" AND ".join(f"target_{d} <> -9999" for d in prices.HORIZONS)}""")
def work_set_rows(spark, sf_dir):
    """The work set with a column for each feature and target."""
    found = work_set(spark, sf_dir)
    columns = [cut(F.get("features", F.lit(k))).alias(c) for k, c in enumerate(training.FEATURES)] + [cut(F.get("targets", F.lit(k))).alias(f"target_{d}") for k, d in enumerate(prices.HORIZONS)]
    return found.select("id", *columns, "document")
