"""Registry of named queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tapeloom.functions.columns import TIMEFRAMES

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    def add(fn: Run) -> Run:
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        REGISTRY[key] = Query(fn, sql)
        return fn

    return add


def ny(ts: str) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


def utc_from_ny(wall: str) -> str:
    return f"(({wall} AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC')"


def rd(expr: str, digits: int = 6) -> str:
    return f"(round(({expr}) + 1e-11, {digits}) + 0.0)"


COMPOUND = "CASE WHEN min(ret) <= -1 THEN -100 ELSE 100 * (exp(sum(ln(CASE WHEN ret > -1 THEN 1 + ret END))) - 1) END"
#: a day's (or trade's) growth in log form and its total losses
GROWTH = "sum(ln(CASE WHEN ret > -1 THEN 1 + ret END)) AS lr, count(*) FILTER (WHERE ret <= -1) AS lost"


def secs(tf: str) -> str:
    return f"INTERVAL '{TIMEFRAMES[tf]} seconds'"


TICKS = (
    "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, "
    "CAST(json_extract(props, '$.k') AS BIGINT) AS size FROM events)"
)
TRADES = (
    "trades AS (SELECT l_suppkey AS symbol, l_returnflag || l_linestatus AS cfg, l_shipdate AS entry_ts, "
    "l_shipdate + INTERVAL 1 DAY AS exit_ts, (round(l_discount * 100) - 5) / 100 AS ret, l_tax AS fee, "
    "l_quantity AS qty, l_extendedprice AS notional, "
    "CASE WHEN l_linenumber % 2 = 1 THEN 'long' ELSE 'short' END AS side, "
    "l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id FROM lineitem)"
)
RUNS = (
    "runs AS (SELECT o_orderkey AS run_id, o_custkey AS symbol, o_orderdate AS created_at, "
    "o_orderpriority AS sweep_tag, o_orderstatus AS strategy, o_totalprice AS metric, "
    "round(o_totalprice / 250000, 2) AS profit_factor, o_orderkey % 97 AS n_trades, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END AS fee FROM orders)"
)


def bars_cte(name: str, tf: str) -> str:
    return (
        f"{name} AS (SELECT symbol, time_bucket({secs(tf)}, ts, TIMESTAMP '2000-01-01') AS ts, "
        "arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, "
        "CAST(sum(size) AS DOUBLE) AS volume, count(*) AS trades FROM ticks GROUP BY 1, 2)"
    )


def numbered_cte(name: str, source: str) -> str:
    return (
        f"{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no "
        f"FROM {source})"
    )


_FRAMES = {"1min": "1m", "5min": "5m", "15min": "15m", "30min": "30m", "1h": "1h", "2h": "2h", "4h": "4h", "1d": "1d"}
_PARTS = {"ticks": ([], TICKS), "trades": ([], TRADES), "runs": ([], RUNS)}
for _tf, _short in _FRAMES.items():
    _PARTS[f"b{_short}"] = (["ticks"], bars_cte(f"b{_short}", _tf))
    _PARTS[f"n{_short}"] = ([f"b{_short}"], numbered_cte(f"n{_short}", f"b{_short}"))


def sql(parts: str, *rest: str, recursive: bool = False) -> str:
    """``WITH`` the named parts, then extra parts, then the final SELECT (last of ``rest``)."""
    done: list[str] = []
    seen: set[str] = set()

    def add(name: str) -> None:
        if name not in seen:
            seen.add(name)
            deps, text = _PARTS[name]
            for d in deps:
                add(d)
            done.append(text)

    for name in parts.split():
        add(name)
    done.extend(rest[:-1])
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ", ".join(done) + " " if done else "") + rest[-1]


def win(n: int, end: int = 0, keys: str = "symbol", seq: str = "bar_no") -> str:
    last = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"(PARTITION BY {keys} ORDER BY {seq} ROWS BETWEEN {n - 1 - end} PRECEDING AND {last})"


def full(agg: str, n: int, end: int = 0) -> str:
    """Aggregate over a full frame of ``n`` bars, NULL before that."""
    return f"CASE WHEN bar_no >= {n - 1 - end} THEN {agg} OVER {win(n, end)} END"


def lagged(expr: str, k: int = 1) -> str:
    return f"lag({expr}, {k}) OVER (PARTITION BY symbol ORDER BY bar_no)"


def ewm_cte(name: str, source: str, values: dict[str, str], alpha: str, q: str = "bar_no") -> str:
    """Exponential means by their closed form: a weighted sum over all earlier bars."""
    sums = ", ".join(
        f"sum(CASE WHEN b._q = 0 THEN 1.0::DOUBLE ELSE {alpha} END * pow(1.0::DOUBLE - {alpha}, a._q - b._q) * b._v{i}) AS {n}"
        for i, n in enumerate(values)
    )
    cols = ", ".join(f"{v} AS _v{i}" for i, v in enumerate(values.values()))
    return (
        f"_{name} AS MATERIALIZED (SELECT symbol, bar_no, {q} AS _q, {cols} FROM {source}), "
        f"{name} AS MATERIALIZED (SELECT a.symbol, a.bar_no, {sums} FROM _{name} a JOIN _{name} b "
        "ON a.symbol = b.symbol AND b._q <= a._q AND b._q >= 0 GROUP BY a.symbol, a.bar_no)"
    )


def ema_cte(name: str, source: str, value: str, span: int) -> str:
    return ewm_cte(name, source, {name: value}, f"(2.0::DOUBLE / {span + 1})")


def rsi_cte(name: str, source: str, n: int, tag: str = "") -> str:
    """Adds ``{name}(symbol, bar_no, ts, close, rsi)`` on top of a numbered source."""
    return (
        f"{name}_d AS MATERIALIZED (SELECT *, close - {lagged('close')} AS chg FROM {source}), "
        + ewm_cte(
            f"{name}_e",
            f"{name}_d",
            {"g": "greatest(chg, 0)", "l": "greatest(-chg, 0)"},
            f"(1.0::DOUBLE / {n})",
            "bar_no - 1",
        )
        + f", {name} AS MATERIALIZED (SELECT d.*, CASE WHEN e.l = 0 AND e.g > 0 THEN 100 WHEN e.l > 0 THEN "
        f"100 - 100 / (1 + e.g / e.l) END AS rsi FROM {name}_d d LEFT JOIN {name}_e e USING (symbol, bar_no))"
    )
