"""The derived tables of ``views`` in plain SQL, as named common table expressions."""

from __future__ import annotations

_ROUND = (
    "'main' AS source, CAST(year({d}) AS INT) AS year, CAST(month({d}) AS INT) AS round_number"
)
_EVENT = "source, year, round_number"
_DRIVER = f"{_EVENT}, driver_id"


def _round(date: str) -> str:
    return _ROUND.format(d=date)


# name -> (views it reads, query)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "laps": (
        (),
        f"""SELECT {_round('l_shipdate')},
              CASE l_returnflag WHEN 'A' THEN 'FP1' WHEN 'N' THEN 'FP2' ELSE 'FP3' END AS session,
              CAST(l_suppkey AS VARCHAR) AS driver_id, l_extendedprice AS lap_time,
              CAST(round(l_extendedprice * 100) AS BIGINT) AS lap_ms
            FROM lineitem""",
    ),
    "quali": (
        (),
        f"""SELECT {_DRIVER}, rank() OVER (PARTITION BY {_EVENT} ORDER BY best_ms) AS position, best, best_ms,
              CASE WHEN best_ms % 3 <> 0 THEN best END AS q3_time,
              CASE WHEN best_ms % 3 <> 0 THEN best_ms END AS q3_ms
            FROM (SELECT {_round('l_shipdate')}, CAST(l_suppkey AS VARCHAR) AS driver_id,
                    min(l_extendedprice) AS best, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS best_ms
                  FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)""",
    ),
    "race": (
        (),
        f"""SELECT {_DRIVER}, rank() OVER (PARTITION BY {_EVENT} ORDER BY total DESC) AS position
            FROM (SELECT {_round('l_shipdate')}, CAST(l_suppkey AS VARCHAR) AS driver_id,
                    sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS total
                  FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)""",
    ),
    "calendar": (
        (),
        f"""SELECT *, 'Round ' || round_number AS event_name FROM (SELECT DISTINCT {_round('o_orderdate')} FROM orders)""",
    ),
    "best": (
        ("laps",),
        f"""SELECT {_EVENT}, session, driver_id, min(lap_ms) AS best_lap FROM laps
            WHERE driver_id IS NOT NULL AND lap_ms IS NOT NULL GROUP BY ALL""",
    ),
    "scored": (
        ("best",),
        f"""SELECT *, best_lap - min(best_lap) OVER (PARTITION BY {_EVENT}, session) AS delta,
              rank() OVER (PARTITION BY {_EVENT}, session ORDER BY best_lap) AS rank FROM best""",
    ),
    "wide": (
        ("scored",),
        f"""SELECT {_DRIVER}, driver_id AS driver_name,
              max(CASE WHEN session = 'FP1' THEN delta END) AS fp1_delta, max(CASE WHEN session = 'FP1' THEN rank END) AS fp1_rank,
              max(CASE WHEN session = 'FP2' THEN delta END) AS fp2_delta, max(CASE WHEN session = 'FP2' THEN rank END) AS fp2_rank,
              max(CASE WHEN session = 'FP3' THEN delta END) AS fp3_delta, max(CASE WHEN session = 'FP3' THEN rank END) AS fp3_rank
            FROM scored GROUP BY {_DRIVER}""",
    ),
    "features": (
        ("wide",),
        """SELECT *,
              CAST(coalesce(fp1_delta, 0) + coalesce(fp2_delta, 0) + coalesce(fp3_delta, 0) AS DOUBLE)
                / ((fp1_delta IS NOT NULL)::INT + (fp2_delta IS NOT NULL)::INT + (fp3_delta IS NOT NULL)::INT) AS fp_mean_delta,
              CAST(coalesce(fp1_rank, 0) + coalesce(fp2_rank, 0) + coalesce(fp3_rank, 0) AS DOUBLE)
                / ((fp1_rank IS NOT NULL)::INT + (fp2_rank IS NOT NULL)::INT + (fp3_rank IS NOT NULL)::INT) AS fp_mean_rank
            FROM wide""",
    ),
    "points": (
        ("race",),
        """SELECT source, year, round_number, driver_id,
              CASE position WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 WHEN 4 THEN 12 WHEN 5 THEN 10
                WHEN 6 THEN 8 WHEN 7 THEN 6 WHEN 8 THEN 4 WHEN 9 THEN 2 WHEN 10 THEN 1 ELSE 0 END AS points
            FROM race WHERE position <= 10""",
    ),
    "standings": (
        ("points", "calendar"),
        f"""SELECT *, rank() OVER (PARTITION BY {_EVENT} ORDER BY points DESC) AS position_start
            FROM (SELECT c.source, c.year, c.round_number, p.driver_id, CAST(sum(p.points) AS BIGINT) AS points
                  FROM calendar c JOIN points p ON c.source = p.source AND c.year = p.year AND p.round_number < c.round_number
                  GROUP BY ALL)""",
    ),
    "targets": (
        ("quali",),
        f"""SELECT {_DRIVER}, q3_ms, q3_ms - min(q3_ms) OVER (PARTITION BY {_EVENT}) AS target
            FROM quali WHERE q3_ms IS NOT NULL""",
    ),
    "train_qualifying": (
        ("features", "targets"),
        """SELECT f.*, t.target, f.year AS event_year, f.round_number AS event_round,
              CAST(f.year * 100 + f.round_number AS INT) AS event_key
            FROM features f JOIN targets t USING (source, year, round_number, driver_id)""",
    ),
    "train_race": (
        ("features", "quali", "race"),
        """SELECT f.*, CAST(q.position AS DOUBLE) AS qualy_position, CAST(r.position AS DOUBLE) AS target,
              f.year AS event_year, f.round_number AS event_round, CAST(f.year * 100 + f.round_number AS INT) AS event_key
            FROM features f JOIN quali q USING (source, year, round_number, driver_id)
              JOIN race r USING (source, year, round_number, driver_id)""",
    ),
    "folds": (
        ("train_race",),
        """SELECT event_key, train_events FROM (
              SELECT event_key, row_number() OVER (ORDER BY event_key) - 1 AS train_events, count(*) OVER () AS n
              FROM (SELECT DISTINCT event_key FROM train_race))
            WHERE n >= 4 AND train_events >= greatest(3, n // 3)""",
    ),
    "runs": (
        (),
        """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS created_at, o_orderpriority AS sport,
              CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'RUNNING' END AS status,
              CAST(o_custkey AS VARCHAR) AS sweep_id FROM orders""",
    ),
    "run_states": (
        ("runs",),
        """SELECT id, created_at, sport, sweep_id,
              CASE lower(status) WHEN 'success' THEN 'done' WHEN 'failed' THEN 'error' ELSE lower(status) END AS status FROM runs""",
    ),
    "run_results": (
        (),
        """SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CAST(l_suppkey AS VARCHAR) AS driver_name, l_extendedprice AS pred,
              CAST(round(l_extendedprice * 100) AS BIGINT) AS pred_ms FROM lineitem""",
    ),
    "matches": (
        (),
        """SELECT CAST(o_orderkey AS VARCHAR) AS match_id, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS date,
              CAST(year(o_orderdate) AS INT) AS season, o_orderpriority AS league,
              CAST(o_custkey % 20 AS VARCHAR) AS home_team_id,
              CAST((o_custkey + 1 + o_orderkey % 19) % 20 AS VARCHAR) AS away_team_id,
              CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 5 AS INT) END AS home_goals,
              CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 4 AS INT) END AS away_goals FROM orders""",
    ),
    "drivers": (
        (),
        """SELECT CAST(s_suppkey AS VARCHAR) AS driver_id, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS name_acronym,
              n_name AS country_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "projects": (
        (),
        """SELECT c_mktsegment AS sport, replace(c_name, '#', '_') AS name,
              CASE WHEN c_custkey % 3 <> 0 THEN 'Jupyter' END AS notebook,
              CASE WHEN c_custkey % 5 <> 0 THEN 'Python' END AS python_dir FROM customer""",
    ),
    "papers": (
        (),
        """SELECT p_type AS sport,
              'papers/' || p_type || '/' || replace(p_name, ' ', '-') || '-' || p_partkey || '.pdf' AS path FROM part""",
    ),
}


def with_views(body: str, *names: str) -> str:
    """The query with the views it names, and the views those read, in front of it."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in VIEWS[name][0]:
            visit(parent)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in ordered]
    return f"WITH {', '.join(parts)} {body}"
