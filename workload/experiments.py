"""Runs, sweeps and the research catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.operators import catalog
from paddock.operators import experiments as ex
from paddock.operators.ordering import carry_forward
from paddock.sources.readers import table_status
from paddock.streaming import live
from workload import views
from workload.registry import register
from workload.sqlviews import with_views


def _sweep_runs(spark, d):
    """A run belongs to the sweep of its customer; the parameter value is the order's month."""
    return views.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("sweep_id"),
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.month("o_orderdate").cast("string").alias("param_value"),
    )


_SWEEP_RUNS = """sweep_runs AS (SELECT CAST(o_custkey AS VARCHAR) AS sweep_id, CAST(o_orderkey AS VARCHAR) AS run_id,
  CAST(month(o_orderdate) AS VARCHAR) AS param_value FROM orders)"""


@register("run_score", with_views("SELECT run_id, round(sum(pred_ms)::DOUBLE / count(pred_ms), 6) AS score FROM run_results GROUP BY ALL", "run_results"))
def run_score(spark, d):
    scores = ex.run_scores(views.run_results(spark, d), pred="pred_ms")
    return scores.withColumn("score", F.round("score", 6))


@register(
    "status_counts",
    with_views(
        """SELECT count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS failed,
             count(*) FILTER (status NOT IN ('done', 'error')) AS pending FROM run_states""",
        "run_states",
    ),
)
def status_counts(spark, d):
    return ex.status_counts(views.runs(spark, d))


@register(
    "sweep_status",
    with_views(
        """SELECT sweep_id, CASE WHEN count(*) FILTER (status = 'error') = 0 THEN 'done'
             WHEN count(*) FILTER (status = 'done') = 0 THEN 'error' ELSE 'partial' END AS status FROM run_states GROUP BY ALL""",
        "run_states",
    ),
)
def sweep_status(spark, d):
    return ex.sweep_status(views.runs(spark, d))


@register(
    "sweep_progress",
    with_views(
        "SELECT sweep_id, count(*) FILTER (status IN ('done', 'error')) AS finished, count(*) AS total FROM run_states GROUP BY ALL",
        "run_states",
    ),
)
def sweep_progress(spark, d):
    return ex.sweep_progress(views.runs(spark, d))


@register(
    "sweep_runs_join",
    with_views(
        f""", {_SWEEP_RUNS} SELECT r.id, r.created_at, r.status, s.param_value FROM runs r JOIN sweep_runs s ON r.id = s.run_id
            WHERE s.sweep_id = '42'""",
        "runs",
    ),
)
def sweep_runs_join(spark, d):
    rows = ex.sweep_runs_of(views.runs(spark, d), _sweep_runs(spark, d), "42")
    return rows.select("id", "created_at", "status", "param_value")


@register(
    "sweep_summary",
    with_views(
        f""", {_SWEEP_RUNS}, scores AS (SELECT run_id, round(sum(pred_ms)::DOUBLE / count(pred_ms), 6) AS score FROM run_results GROUP BY ALL)
            SELECT s.sweep_id, s.run_id, r.created_at, r.status, s.param_value, x.score
            FROM sweep_runs s JOIN run_states r ON r.id = s.run_id LEFT JOIN scores x ON x.run_id = s.run_id""",
        "run_states",
        "run_results",
    ),
)
def sweep_summary(spark, d):
    rows = views.run_results(spark, d).select("run_id", F.col("pred_ms").alias("pred"))
    summary = ex.sweep_summary(views.runs(spark, d), _sweep_runs(spark, d), rows)
    return summary.withColumn("score", F.round("score", 6))


@register(
    "sweep_grid",
    """SELECT o_orderkey, v AS param_value, 'mode=' || o_orderstatus || '&round=' || v || '&year=' || year(o_orderdate) AS params
       FROM orders, (VALUES ('1'), ('2.5'), ('auto'), ('[1,2]')) t(v)""",
)
def sweep_grid(spark, d):
    """Orders as base configurations, the round swept over a number, a fraction, a text and a list."""
    base = F.create_map(
        F.lit("year"), F.year("o_orderdate").cast("string"), F.lit("round"), F.lit("9"), F.lit("mode"), F.col("o_orderstatus")
    )
    sweeps = views.table(spark, d, "orders").select(
        "o_orderkey", base.alias("base"), F.lit("round").alias("param"), F.lit('[1, 2.5, "auto", [1, 2]]').alias("values")
    )
    grid = ex.sweep_grid(sweeps, "base", "param", "values")
    pairs = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return grid.select("o_orderkey", "param_value", F.array_join(pairs, "&").alias("params"))


@register(
    "daily_counts",
    with_views(
        """SELECT strftime(day, '%Y-%m-%d') AS day, (SELECT count(*) FROM runs WHERE CAST(created_at AS DATE) = day) AS runs
           FROM (SELECT CAST(unnest(generate_series(DATE '2001-07-20', DATE '2001-08-18', INTERVAL 1 DAY)) AS DATE) AS day)""",
        "runs",
    ),
)
def daily_counts(spark, d):
    return ex.daily_counts(spark, views.runs(spark, d), "2001-08-18", 30)


@register("latest_runs", with_views("SELECT id, created_at, sport, status FROM runs ORDER BY created_at DESC, id DESC LIMIT 8", "runs"))
def latest_runs(spark, d):
    return ex.latest(views.runs(spark, d), 8).select("id", "created_at", "sport", "status")


@register("list_runs", with_views("SELECT id, created_at, sport, status FROM run_states", "run_states"))
def list_runs(spark, d):
    return ex.list_newest_first(views.runs(spark, d), "id", "created_at", "sport", "status")


@register("get_run", with_views("SELECT id, created_at, sport, status, sweep_id FROM runs WHERE id = '123'", "runs"))
def get_run(spark, d):
    return ex.find_run(views.runs(spark, d), "123").select("id", "created_at", "sport", "status", "sweep_id")


@register(
    "current_state",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def current_state(spark, d):
    log = views.table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return ex.current_state(log, "user_id", ["ts", "event_id"]).drop("ts")


@register(
    "upsert_latest",
    """SELECT c_custkey, coalesce(o.total, c_acctbal) AS balance, CASE WHEN o.total IS NULL THEN 'old' ELSE 'new' END AS origin
       FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS total FROM orders GROUP BY ALL) o ON o_custkey = c_custkey""",
)
def upsert_latest(spark, d):
    existing = views.table(spark, d, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("balance"), F.lit("old").alias("origin"), F.lit(-1).cast("bigint").alias("version")
    )
    changes = views.table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("balance"),
        F.lit("new").alias("origin"),
        F.col("o_orderkey").alias("version"),
    )
    return ex.upsert_latest(existing, changes, "c_custkey", ["version"]).drop("version")


@register(
    "sweep_abort_cascade",
    with_views(
        """SELECT id, r.sweep_id, CASE WHEN s.status = 'error' AND r.status IN ('queued', 'running') THEN 'error' ELSE r.status END AS status
           FROM run_states r LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS sweep_id,
             CASE WHEN c_custkey % 4 = 0 THEN 'error' ELSE 'running' END AS status FROM customer) s ON s.sweep_id = r.sweep_id""",
        "run_states",
    ),
)
def sweep_abort_cascade(spark, d):
    from paddock.functions.scalars import status_word

    key = F.col("c_custkey")
    sweeps = views.table(spark, d, "customer").select(
        key.cast("string").alias("id"), F.when(key % 4 == 0, "failed").otherwise("running").alias("status")
    )
    runs = views.runs(spark, d).withColumn("status", status_word(F.col("status")))
    return ex.abort_cascade(runs, sweeps).select("id", "sweep_id", "status")


@register(
    "runs_compare",
    with_views(
        """SELECT driver_name, max(CASE WHEN run_id = '5979' THEN pred END) AS "5979", max(CASE WHEN run_id = '7124' THEN pred END) AS "7124",
             max(CASE WHEN run_id = '11' THEN pred END) AS "11" FROM run_results WHERE run_id IN ('5979', '7124', '11') GROUP BY ALL""",
        "run_results",
    ),
)
def runs_compare(spark, d):
    return ex.runs_compare(views.run_results(spark, d), ["5979", "7124", "11"])


@register("readiness")
def readiness(spark, d):
    """Customers, orders and parts stand for teams, matches and fixtures."""
    names = F.create_map(F.lit("customer"), F.lit("teams"), F.lit("orders"), F.lit("matches"), F.lit("part"), F.lit("fixtures"))
    status = table_status(spark, d, ["customer", "orders", "part"])
    return ex.readiness(status.withColumn("name", F.try_element_at(names, F.col("name"))))


# -- catalogue ---------------------------------------------------------------


@register(
    "keyword_search",
    "SELECT doc_id, source FROM documents WHERE contains(trim(replace(lower(text), '_', ' ')), 'the')",
)
def keyword_search(spark, d):
    items = views.table(spark, d, "documents").select("doc_id", "source", "text")
    return catalog.keyword_search(items, " The_", ["text"]).select("doc_id", "source")


@register(
    "search_scopes",
    with_views(
        """SELECT 'projects' AS scope, sport, name AS title FROM projects WHERE contains(trim(replace(lower(name), '_', ' ')), '12')
           UNION ALL SELECT 'papers', sport, title FROM (SELECT sport, replace(regexp_extract(path, '([^/]+)\\.pdf$', 1), '-', ' ') AS title,
             regexp_extract(path, '([^/]+)$', 1) AS file FROM papers)
           WHERE contains(trim(replace(lower(title), '_', ' ')), '12') OR contains(trim(replace(lower(file), '_', ' ')), '12')""",
        "projects",
        "papers",
    ),
)
def search_scopes(spark, d):
    from paddock.functions.scalars import title_of

    path = F.col("path")
    papers = views.papers(spark, d).select("sport", title_of(path).alias("title"), F.regexp_extract(path, "([^/]+)$", 1).alias("file"))
    return catalog.search_scopes(views.projects(spark, d), papers, "12")


@register(
    "resolve_unique",
    with_views(
        """, hits AS (SELECT q, sport, name FROM projects, (VALUES ('customer 7'), ('tomer 000000149 '), ('none')) t(q)
             WHERE contains(trim(replace(lower(name), '_', ' ')), trim(q)) AND (q <> 'none' OR lower(sport) = 'machinery'))
           SELECT q, min(sport) AS sport, min(name) AS name FROM hits GROUP BY q HAVING count(*) = 1""",
        "projects",
    ),
)
def resolve_unique(spark, d):
    from paddock.operators.dataset import union_sources

    items = views.projects(spark, d).select("sport", "name")
    found = [
        catalog.resolve_unique(items, q, ["name"], sport).select(F.lit(q).alias("q"), "sport", "name")
        for q, sport in (("customer 7", None), ("tomer 000000149 ", None), ("none", "Machinery"))
    ]
    return union_sources(found)


@register(
    "resolve_exact",
    with_views("SELECT sport, name FROM projects WHERE lower(name) = 'customer_000000149' LIMIT 1", "projects"),
)
def resolve_exact(spark, d):
    return catalog.resolve_exact(views.projects(spark, d), "CUSTOMER 000000149", "", "name").select("sport", "name")


@register(
    "overview_counts",
    with_views(
        """SELECT coalesce(p.sport, q.sport) AS sport, coalesce(projects, 0) AS projects, coalesce(notebooks, 0) AS notebooks,
             coalesce(python, 0) AS python, coalesce(papers, 0) AS papers
           FROM (SELECT sport, count(*) AS projects, count(notebook) AS notebooks, count(python_dir) AS python FROM projects GROUP BY ALL) p
             FULL JOIN (SELECT sport, count(*) AS papers FROM papers GROUP BY ALL) q ON p.sport = q.sport""",
        "projects",
        "papers",
    ),
)
def overview_counts(spark, d):
    return catalog.overview_counts(views.projects(spark, d), views.papers(spark, d))


@register(
    "catalog_enrich",
    """SELECT CASE WHEN p_size <= 15 THEN p_brand ELSE sport END AS sport,
             CASE WHEN p_size <= 15 THEN 'Paper on ' || p_name ELSE replace(regexp_extract(path, '([^/]+)\\.pdf$', 1), '-', ' ') END AS title,
             path AS file, CASE WHEN p_size <= 15 THEN 'http://papers.example/' || p_partkey END AS source
           FROM (SELECT p_type AS sport, 'papers/' || p_type || '/' || replace(p_name, ' ', '-') || '-' || p_partkey || '.pdf' AS path,
             p_partkey, p_brand, p_name, p_size FROM part)""",
)
def catalog_enrich(spark, d):
    """The index knows all papers, but those of large parts by another name."""
    part = views.table(spark, d, "part")
    suffix = F.when(F.col("p_size") <= 15, F.lit(".pdf")).otherwise(F.lit("-old.pdf"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"), suffix)
    index = part.select(
        name.alias("file"),
        F.concat(F.lit("Paper on "), "p_name").alias("title"),
        F.col("p_brand").alias("sport"),
        F.concat(F.lit("http://papers.example/"), F.col("p_partkey").cast("string")).alias("source"),
    )
    return catalog.enrich_papers(views.papers(spark, d), index)


@register(
    "paper_index",
    """SELECT p_brand AS doc, replace(p_name, ' ', '-') || '-' || p_partkey || '.pdf' AS file, p_name AS title, p_type AS sport,
         CASE WHEN p_partkey % 2 = 0 THEN 'http://papers.example/' || p_partkey END AS source FROM part""",
)
def paper_index(spark, d):
    """Parts written as the lines of one index per brand, and parsed again."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    source = F.when(
        F.col("p_partkey") % 2 == 0, F.concat(F.lit("- Source: http://papers.example/"), F.col("p_partkey").cast("string"))
    )
    lines = F.array(
        F.lit("**Research papers**"),
        F.concat(F.lit("**"), F.col("p_type"), F.lit("**")),
        F.lit(""),
        F.concat(F.lit("- "), "p_name"),
        F.concat(F.lit("- File: `papers/x/"), name, F.lit("`")),
        F.coalesce(source, F.lit(" ")),
    )
    text = views.table(spark, d, "part").select(F.col("p_brand").alias("doc"), "p_partkey", F.posexplode(lines).alias("i", "text"))
    return catalog.parse_index(text.select("doc", (F.col("p_partkey") * 6 + F.col("i")).alias("line"), "text"))


@register(
    "forward_fill",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
         OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_text FROM conversations""",
)
def forward_fill(spark, d):
    turns = views.table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("user_text")
    )
    return carry_forward(turns, ["conv_id"], "turn", ["user_text"])


# -- incremental modes -------------------------------------------------------


def _changes(spark, d):
    return live.stream_table(spark, d, "events.parquet", views.table(spark, d, "events").schema)


@register(
    "stream_current_state",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def stream_current_state(spark, d):
    log = _changes(spark, d).select("user_id", "event_id", "event_type", "value", "ts")
    return live.drain(live.live_state(log, "user_id", ["ts", "event_id"]), "state").drop("ts")


@register("stream_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS runs FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    return live.drain(live.live_daily_counts(_changes(spark, d), "ts"), "daily", "update", ["day"])


_SPANS = """WITH c AS (SELECT *, lag(ts) OVER k AS ts_before, lag(event_type) OVER k AS type_before FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)),
  g AS (SELECT *, count(*) FILTER (type_before IN ('purchase', 'error') OR ts >= ts_before + INTERVAL 36 HOUR) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c),
  r AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1, last(event_type ORDER BY ts, event_id) AS state, count(*) AS changes FROM g GROUP BY user_id, run),
  spans AS (SELECT user_id, t0, CASE WHEN state IN ('purchase', 'error') THEN t1 ELSE t1 + INTERVAL 36 HOUR END AS t2,
      CASE WHEN state IN ('purchase', 'error') THEN state ELSE 'aborted' END AS state, changes FROM r)
  SELECT user_id, strftime(t0, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(t2, '%Y-%m-%d %H:%M:%S.%f') AS ended, state, changes,
    (epoch_us(t2) - epoch_us(t0)) / 1000000 AS seconds FROM spans"""
#: A user's events as the states of runs that end with a purchase or an error, or are aborted after 36 hours without a change.
_SPAN_RULE = {"key": "user_id", "time": "ts", "order": "event_id", "state": "event_type", "final": ["purchase", "error"], "patience_seconds": 36 * 3600}


def _shown(spans):
    return spans.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("started", "ended")})


@register("run_spans", _SPANS)
def run_spans(spark, d):
    return _shown(ex.run_spans(views.table(spark, d, "events"), **_SPAN_RULE))


@register("stream_run_spans", _SPANS + " WHERE t2 < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY FROM events)")
def stream_run_spans(spark, d):
    """The runs that are certain once all events are read and two days of lateness are allowed for."""
    return _shown(live.drain(live.live_spans(_changes(spark, d), **_SPAN_RULE), "spans", "append"))
