"""The catalogue's queries as plain SQL for another engine, by brute force on the whole tables."""

from __future__ import annotations

from .catalogue import NOW, SEED, L, N

_EVENTS = """
ev AS (
  SELECT event_id, ts, user_id AS customer_id, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
)"""

_ACTIONS = """
clicks AS (
  SELECT CASE WHEN bad = 0 THEN NULL ELSE customer_id END AS customer_id,
         CASE WHEN bad = 1 THEN 0 WHEN bad = 2 THEN NULL ELSE k + 1 END AS item_id,
         CASE WHEN bad = 3 THEN NULL ELSE ts END AS occurred_at, 1 AS action_type, 'clicks' AS source
  FROM (SELECT *, CASE WHEN event_type = 'error' THEN event_id % 4 ELSE 9 END AS bad FROM ev)
  WHERE event_type IN ('click', 'error')
),
atc AS (
  SELECT customer_id, k + 1 AS item_id, date_trunc('hour', ts) AS occurred_at, 2 AS action_type,
         'atc' AS source
  FROM ev WHERE event_type = 'signup'
),
ords AS (
  SELECT customer_id, k + 1 AS item_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS occurred_at,
         3 AS action_type, 'orders' AS source
  FROM ev WHERE event_type = 'purchase'
),
acts AS (
  SELECT *, CAST(occurred_at AS DATE) AS action_date
  FROM (SELECT * FROM clicks UNION ALL SELECT * FROM atc UNION ALL SELECT * FROM ords)
)"""

_IMPRESSIONS = """
impr AS (
  SELECT CAST(ts AS DATE) AS as_of_date,
         CASE WHEN event_id % 2 = 0 THEN 'dt=' ELSE '' END || CAST(CAST(ts AS DATE) AS VARCHAR) AS dt,
         'r-' || CAST(event_id AS VARCHAR) AS ranking_id, customer_id,
         list_transform(range(event_id % 5), lambda j: CAST(1 + (k + 17 * j) % 100 AS INTEGER)) AS items,
         list_transform(range(event_id % 5), lambda j: (event_id + j) % 7 = 0) AS flags
  FROM ev WHERE event_type = 'view'
)"""

_ORDER_FEEDS = """
impr AS (
  SELECT CAST(o_orderdate AS DATE) AS as_of_date, 'r-' || CAST(o_orderkey AS VARCHAR) AS ranking_id,
         o_custkey AS customer_id,
         list_transform(range(o_orderkey % 5),
                        lambda j: CAST(1 + (7 * o_orderkey + 13 * j) % 2000 AS INTEGER)) AS items,
         list_transform(range(o_orderkey % 5), lambda j: (o_orderkey + j) % 5 = 0) AS flags
  FROM orders
),
acts AS (
  SELECT o_custkey AS customer_id, CAST(l_partkey + 1 AS INTEGER) AS item_id,
         CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS occurred_at, 3 AS action_type,
         CAST(l_shipdate AS DATE) AS action_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

_SHOWN = (
    "array_to_string(list_transform(range(len(items)), "
    "lambda i: CAST(items[i + 1] AS VARCHAR) || CASE WHEN flags[i + 1] THEN '+' ELSE '-' END), ',')"
)

_WINDOW = """
ctx AS (SELECT DISTINCT as_of_date, customer_id FROM impr),
seen AS (
  SELECT c.as_of_date, c.customer_id, a.item_id, a.action_type, a.occurred_at,
         row_number() OVER (PARTITION BY c.as_of_date, c.customer_id
                            ORDER BY a.occurred_at DESC, a.action_type DESC, a.item_id DESC) AS rn
  FROM ctx c JOIN acts a ON a.customer_id = c.customer_id
   AND a.action_date < c.as_of_date AND a.action_date >= c.as_of_date - {l}
),
hist AS (
  SELECT c.as_of_date, c.customer_id,
         list_resize(coalesce(list(s.item_id ORDER BY s.rn) FILTER (s.rn IS NOT NULL), []::INT[]),
                     {n}, 0) AS actions,
         list_resize(coalesce(list(s.action_type ORDER BY s.rn) FILTER (s.rn IS NOT NULL), []::INT[]),
                     {n}, 0) AS action_types
  FROM ctx c LEFT JOIN seen s
    ON s.as_of_date = c.as_of_date AND s.customer_id = c.customer_id AND s.rn <= {n}
  GROUP BY c.as_of_date, c.customer_id
),
run AS (
  SELECT i.as_of_date, i.ranking_id, i.customer_id, i.items, i.flags, h.actions, h.action_types
  FROM impr i LEFT JOIN hist h ON i.as_of_date = h.as_of_date AND i.customer_id = h.customer_id
)"""

_TRAIN_WINDOW = """
every_impr AS (SELECT * FROM impr),
newest_impr AS (
  SELECT * FROM every_impr WHERE as_of_date >= (SELECT max(as_of_date) FROM every_impr) - 13
)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _actions(select: str) -> str:
    return _with(_EVENTS, _ACTIONS, select=select)


def _impressions(select: str) -> str:
    return _with(_EVENTS, _IMPRESSIONS, select=select)


def _run(select: str, n: int = N, days: int = L) -> str:
    return _with(_EVENTS, _ACTIONS, _IMPRESSIONS, _WINDOW.format(n=n, l=days), select=select)


def _orders_run(select: str) -> str:
    return _with(_ORDER_FEEDS, _WINDOW.format(n=N, l=365), select=select)


def _action_rows(source: str) -> str:
    return _actions(
        "SELECT customer_id, item_id, epoch_us(occurred_at) AS occurred_at, action_type, source, "
        f"CAST(occurred_at AS DATE) AS action_date FROM {source}"
    )


_HISTORY_ROWS = """SELECT as_of_date, customer_id, array_to_string(actions, ',') AS actions,
       array_to_string(action_types, ',') AS action_types FROM hist"""

_NESTED_ROWS = f"""SELECT as_of_date, ranking_id, customer_id, {_SHOWN} AS impressions,
       array_to_string(actions, ',') AS actions,
       array_to_string(action_types, ',') AS action_types FROM run"""

_EXPLODED_ROWS = """SELECT as_of_date, ranking_id, customer_id, impression_item_id, is_order,
       array_to_string(actions, ',') AS actions, array_to_string(action_types, ',') AS action_types
FROM (SELECT *, unnest(items) AS impression_item_id, unnest(flags) AS is_order FROM run)"""

_NORMALISED = _impressions(
    f"SELECT as_of_date, ranking_id, customer_id, {_SHOWN} AS impressions FROM impr"
)

_AUDIT = """,
kept AS (
  SELECT *, (occurred_at, action_type, item_id) AS e,
         lag((occurred_at, action_type, item_id)) OVER (PARTITION BY as_of_date, customer_id ORDER BY rn) AS newer
  FROM seen WHERE rn <= {n}
),
totals AS (SELECT as_of_date, customer_id, count(*) AS candidates FROM seen GROUP BY 1, 2)
SELECT c.as_of_date, c.customer_id, CAST(count(k.rn) AS INTEGER) AS kept,
       epoch_us(max(k.occurred_at)) AS newest_at, epoch_us(min(k.occurred_at)) AS oldest_at,
       CAST(coalesce(count_if(CAST(k.occurred_at AS DATE) >= c.as_of_date), 0) AS INTEGER) AS not_before,
       CAST(coalesce(count_if(CAST(k.occurred_at AS DATE) < c.as_of_date - {l}), 0) AS INTEGER) AS too_old,
       CAST(greatest(count(k.rn) - {n}, 0) AS INTEGER) AS over_limit,
       CAST(coalesce(count_if(k.newer < k.e), 0) AS INTEGER) AS out_of_order,
       CAST(least(coalesce(any_value(t.candidates), 0), {n}) - count(k.rn) AS BIGINT) AS missing,
       CAST(0 AS INTEGER) AS absent
FROM ctx c
LEFT JOIN kept k ON k.as_of_date = c.as_of_date AND k.customer_id = c.customer_id
LEFT JOIN totals t ON t.as_of_date = c.as_of_date AND t.customer_id = c.customer_id
GROUP BY 1, 2"""


def _candidates(window: str) -> str:
    return _with(
        _EVENTS,
        _ACTIONS,
        _IMPRESSIONS,
        select=f"""SELECT c.as_of_date, c.customer_id, count(a.action_date) AS candidates
FROM (SELECT DISTINCT as_of_date, customer_id FROM impr) c
LEFT JOIN acts a ON a.customer_id = c.customer_id AND a.action_date < c.as_of_date{window}
GROUP BY 1, 2""",
    )


def _name(column: str) -> str:
    return (
        f"CASE {column} WHEN 0 THEN 'pad' WHEN 1 THEN 'click' WHEN 2 THEN 'atc' "
        "WHEN 3 THEN 'order' ELSE 'unk' END"
    )


_KEYS_TEXT = "CAST(as_of_date AS VARCHAR) || '|' || ranking_id || '|' || CAST(customer_id AS VARCHAR)"

_PICKED_CUSTOMERS = f"""SELECT customer_id FROM (SELECT DISTINCT customer_id FROM impr)
ORDER BY md5('{SEED}|' || CAST(customer_id AS VARCHAR)), customer_id LIMIT 10"""

_PICKED_ROWS = f"""SELECT * FROM run
ORDER BY md5('{SEED}|' || {_KEYS_TEXT}), as_of_date, ranking_id, customer_id LIMIT 10"""


def _draw(use: str, slot: str = "0") -> str:
    key = f"'{SEED}|{use}|' || c || '|' || CAST(day AS VARCHAR) || '|' || CAST({slot} AS VARCHAR)"
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"


def _item(use: str, slot: str = "0") -> str:
    return f"CAST(1 + {_draw(use, slot)} % 200 AS INTEGER)"


def _back(low: int, high: int, use: str, slot: str = "0") -> str:
    return f"CAST(day - CAST({low} + {_draw(use, slot)} % {high - low + 1} AS INTEGER) AS VARCHAR)"


_SYNTHETIC = f"""WITH base AS (
  SELECT c_custkey AS customer_id, CAST(c_custkey AS VARCHAR) AS c,
         CAST(unnest(range(DATE '2024-01-01', DATE '2024-01-04', INTERVAL 1 DAY)) AS DATE) AS day
  FROM customer
),
shown AS (
  SELECT *, unnest(range(10)) AS slot FROM base
),
clicked AS (
  SELECT *, unnest(range(1, 2 + {_draw('clicks')} % 4)) AS slot FROM base
)
SELECT 'impressions' AS feed, customer_id, CAST(day AS VARCHAR) AS event_time,
       CAST(NULL AS INTEGER) AS item_id,
       string_agg(CAST({_item('shown', 'slot')} AS VARCHAR)
                  || CASE WHEN {_draw('label', 'slot')} % 1000 < 150 THEN '+' ELSE '-' END,
                  ',' ORDER BY slot) AS shown
FROM shown GROUP BY customer_id, day
UNION ALL
SELECT 'clicks', customer_id,
       {_back(1, 3, 'click day', 'slot')} || ' '
       || lpad(CAST({_draw('click hour', 'slot')} % 24 AS VARCHAR), 2, '0') || ':00:00',
       {_item('click item', 'slot')}, NULL
FROM clicked
UNION ALL
SELECT 'atc', customer_id, {_back(1, 5, 'atc day')} || ' 11:00:00', {_item('atc item')}, NULL
FROM base WHERE {_draw('atc')} % 1000 < 600
UNION ALL
SELECT 'orders', customer_id, {_back(2, 7, 'order day')}, {_item('order item')}, NULL
FROM base WHERE {_draw('order')} % 1000 < 400"""


_ITEM_INDEX = """,
counted AS (
  SELECT item_id, count(*) AS frequency
  FROM (SELECT item_id FROM acts UNION ALL SELECT unnest(items) FROM impr) WHERE item_id <> 0 GROUP BY item_id
),
idx AS (
  SELECT CAST(item_id AS BIGINT) AS item_id, frequency,
         CAST(1 + row_number() OVER (ORDER BY frequency DESC, item_id) AS INTEGER) AS item_index
  FROM counted
)"""

# Ranked by the items themselves; their numbers are looked up last.
_INDEXED = f""",
numbered AS (
  SELECT s.as_of_date, s.customer_id, s.rn, s.action_type, coalesce(idx.item_index, 1) AS item_index
  FROM seen s LEFT JOIN idx ON idx.item_id = s.item_id WHERE s.rn <= {N}
)
SELECT c.as_of_date, c.customer_id,
       array_to_string(list_resize(coalesce(list(n.item_index ORDER BY n.rn) FILTER (n.rn IS NOT NULL), []::INT[]), {N}, 0), ',') AS actions,
       array_to_string(list_resize(coalesce(list(n.action_type ORDER BY n.rn) FILTER (n.rn IS NOT NULL), []::INT[]), {N}, 0), ',') AS action_types
FROM ctx c LEFT JOIN numbered n ON n.as_of_date = c.as_of_date AND n.customer_id = c.customer_id
GROUP BY c.as_of_date, c.customer_id"""

_DEDUPED = f"""WITH {_EVENTS},{_ACTIONS},{_IMPRESSIONS},
ctx AS (SELECT DISTINCT as_of_date, customer_id FROM impr),
every AS (
  SELECT c.as_of_date, c.customer_id, a.item_id % 3 AS item_id, a.action_type, a.occurred_at,
         row_number() OVER (PARTITION BY c.as_of_date, c.customer_id
                            ORDER BY a.occurred_at DESC, a.action_type DESC, a.item_id % 3 DESC NULLS LAST) AS rn
  FROM ctx c JOIN acts a ON a.customer_id = c.customer_id
   AND a.action_date < c.as_of_date AND a.action_date >= c.as_of_date - {L}
),
marked AS (
  SELECT *, lag(rn) OVER w IS NOT NULL AND item_id IS NOT DISTINCT FROM lag(item_id) OVER w AND action_type = lag(action_type) OVER w AS repeats
  FROM every WINDOW w AS (PARTITION BY as_of_date, customer_id ORDER BY rn)
),
heads AS (
  SELECT *, row_number() OVER (PARTITION BY as_of_date, customer_id ORDER BY rn) AS nth FROM marked WHERE NOT repeats
)
SELECT c.as_of_date, c.customer_id,
       array_to_string(list_resize(coalesce(list(h.item_id ORDER BY h.nth) FILTER (h.nth IS NOT NULL), []::INT[]), {N}, 0), ',') AS actions,
       array_to_string(list_resize(coalesce(list(h.action_type ORDER BY h.nth) FILTER (h.nth IS NOT NULL), []::INT[]), {N}, 0), ',') AS action_types
FROM ctx c LEFT JOIN heads h ON h.as_of_date = c.as_of_date AND h.customer_id = c.customer_id AND h.nth <= {N}
GROUP BY c.as_of_date, c.customer_id"""

# The file's order is that of its keys.
_TIME_ORDER = """WITH judged AS (
  SELECT o_custkey AS customer_id, o_orderdate AS t,
         max(o_orderdate) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached,
         lag(o_orderdate) OVER w AS before
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
)
SELECT customer_id, count(*) AS rows, count(*) FILTER (t IS NULL) AS untimed,
       count(*) FILTER (t < reached) AS out_of_order, count(*) FILTER (t < before) AS steps_back,
       CAST(coalesce(max(epoch_us(reached) - epoch_us(t)) FILTER (t < reached), 0) AS BIGINT) AS worst_micros
FROM judged GROUP BY customer_id HAVING count(*) FILTER (t < reached) > 0 OR count(*) FILTER (t IS NULL) > 0"""

_SIGNS = """,
ordered AS (
  SELECT customer_id, item_id, action_date AS day, count(*) AS orders FROM acts WHERE action_type = 3 GROUP BY 1, 2, 3
),
signs AS (
  SELECT customer_id, item_id, action_date AS day, CASE action_type WHEN 1 THEN 'click' ELSE 'atc' END AS kind
  FROM acts WHERE action_type IN (1, 2)
  UNION ALL
  SELECT customer_id, unnest(items), as_of_date, 'impression' FROM impr
),
lagged AS (
  SELECT o.customer_id, o.item_id, o.day, any_value(o.orders) AS orders,
         CAST(min(o.day - s.day) FILTER (s.kind = 'click') AS INTEGER) AS click_lag,
         CAST(min(o.day - s.day) FILTER (s.kind = 'atc') AS INTEGER) AS atc_lag,
         CAST(min(o.day - s.day) FILTER (s.kind = 'impression') AS INTEGER) AS impression_lag,
         CAST(min(o.day - s.day) AS INTEGER) AS lag_days
  FROM ordered o LEFT JOIN signs s ON s.customer_id = o.customer_id AND s.item_id = o.item_id AND s.day <= o.day
  GROUP BY o.customer_id, o.item_id, o.day
)"""


ORACLE: dict[str, str] = {
    "clicks_norm": _action_rows("clicks"),
    "atc_norm": _action_rows("atc"),
    "orders_norm": _action_rows("ords"),
    "actions_union": _action_rows("acts"),
    "normalize_impressions_raw": _NORMALISED,
    "normalize_impressions_idem": _NORMALISED,
    "contexts": _impressions("SELECT DISTINCT as_of_date, customer_id FROM impr"),
    "train_window": _with(
        _EVENTS, _IMPRESSIONS, _TRAIN_WINDOW, select="SELECT dt, ranking_id, customer_id FROM newest_impr"
    ),
    "impression_items": _impressions(
        "SELECT as_of_date, ranking_id, customer_id, unnest(items) AS impression_item_id, "
        "unnest(flags) AS is_order FROM impr"
    ),
    "histories": _run(_HISTORY_ROWS),
    "histories_orders": _orders_run(_HISTORY_ROWS),
    "item_index": _impressions("").replace(_IMPRESSIONS, _ACTIONS + "," + _IMPRESSIONS).rstrip()
    + _ITEM_INDEX
    + " SELECT item_id, item_index, frequency FROM idx",
    "histories_indexed": _run("").rstrip() + _ITEM_INDEX + _INDEXED,
    "histories_deduped": _DEDUPED,
    "time_order_report": _TIME_ORDER,
    "signs_before_orders": _run("").rstrip()
    + _SIGNS
    + " SELECT customer_id, item_id, day, orders, click_lag, atc_lag, impression_lag, lag_days FROM lagged",
    "orders_without_prior_action": _run("").rstrip()
    + _SIGNS
    + """ SELECT day, CAST(sum(orders) AS BIGINT) AS orders,
       CAST(coalesce(sum(orders) FILTER (lag_days IS NULL), 0) AS BIGINT) AS without_prior,
       CAST(coalesce(sum(orders) FILTER (click_lag IS NULL), 0) AS BIGINT) AS without_click,
       CAST(coalesce(sum(orders) FILTER (atc_lag IS NULL), 0) AS BIGINT) AS without_atc,
       CAST(coalesce(sum(orders) FILTER (impression_lag IS NULL), 0) AS BIGINT) AS without_impression,
       CAST(coalesce(sum(orders) FILTER (lag_days = 0), 0) AS BIGINT) AS same_day, max(lag_days) AS longest_lag
FROM lagged GROUP BY day""",
    "sample_per_day": _impressions(
        f"""SELECT as_of_date, ranking_id, customer_id, impression_item_id, is_order
FROM (SELECT as_of_date, ranking_id, customer_id, unnest(items) AS impression_item_id, unnest(flags) AS is_order FROM impr)
QUALIFY row_number() OVER (PARTITION BY as_of_date ORDER BY md5('{SEED}|' || CAST(as_of_date AS VARCHAR) || '|' || ranking_id
  || '|' || CAST(customer_id AS VARCHAR) || '|' || CAST(impression_item_id AS VARCHAR)), ranking_id, customer_id, impression_item_id) <= 20"""
    ),
    "reject_times": """WITH raw AS (
  SELECT event_id, event_id % 5 AS nth, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events
), text AS (
  SELECT event_id, nth,
         CASE nth WHEN 1 THEN '2024-13-45' WHEN 2 THEN NULL WHEN 3 THEN 'dt=' || t[1:10] ELSE t[1:10] END AS dt,
         CASE nth WHEN 4 THEN t || ' or so' WHEN 2 THEN NULL ELSE t END AS click_time
  FROM raw
)
SELECT event_id, dt, click_time,
       CASE WHEN nth IN (1, 4) THEN dt END AS rejected_dt, CASE WHEN nth IN (1, 4) THEN click_time END AS rejected_time,
       CASE nth WHEN 1 THEN 'dt' WHEN 4 THEN 'click_time' ELSE '' END AS bad_fields
FROM text""",
    "topn_actions": _run(
        "SELECT as_of_date, customer_id, CAST(rn AS INTEGER) AS action_rank, item_id, action_type, "
        f"epoch_us(occurred_at) AS occurred_at FROM seen WHERE rn <= {N}"
    ),
    "candidates_before": _candidates(""),
    "candidates_window": _candidates(f" AND a.action_date >= c.as_of_date - {L}"),
    "examples_nested": _run(_NESTED_ROWS),
    "examples_exploded": _run(_EXPLODED_ROWS),
    "training_inputs": _run(_NESTED_ROWS),
    "training_inputs_exploded": _run(_EXPLODED_ROWS),
    "training_inputs_default": _run(_NESTED_ROWS, 1000, 365),
    "training_inputs_train_window": _with(
        _EVENTS,
        _ACTIONS,
        _IMPRESSIONS,
        _TRAIN_WINDOW,
        _WINDOW.format(n=N, l=L).replace("FROM impr", "FROM newest_impr"),
        select=_NESTED_ROWS,
    ),
    "training_inputs_orders": _orders_run(_NESTED_ROWS),
    "quality_report": _actions(
        f"""SELECT count(*) AS rows,
       count(*) FILTER (customer_id IS NULL) AS null_customer_ids,
       count(*) FILTER (occurred_at > TIMESTAMP '{NOW}') AS future_actions,
       (SELECT count(*) FROM (
          SELECT 1 FROM acts
          GROUP BY customer_id, item_id, action_type, occurred_at, action_date, source
          HAVING count(*) > 1)) AS duplicate_action_rows,
       count(*) FILTER (item_id = 0) AS zero_item_ids,
       count(*) FILTER (occurred_at IS NULL) AS undated_actions
FROM acts"""
    ),
    "duplicate_groups": _actions(
        """SELECT customer_id, item_id, action_type, epoch_us(occurred_at) AS occurred_at, action_date,
       source, count(*) AS copies
FROM acts GROUP BY ALL HAVING count(*) > 1"""
    ),
    "leak_count": _run(
        f"SELECT count(*) AS leaks FROM seen WHERE rn <= {N} AND CAST(occurred_at AS DATE) = as_of_date"
    ),
    "history_audit": _run("").rstrip() + _AUDIT.format(n=N, l=L),
    "upstream_same_day": _run(
        """SELECT count(*) AS same_day_actions,
       count(DISTINCT (c.as_of_date, c.customer_id)) AS contexts_hit
FROM acts a JOIN ctx c ON a.customer_id = c.customer_id AND a.action_date = c.as_of_date"""
    ),
    "reject_split": _with(
        _EVENTS,
        select="""SELECT event_id, CASE WHEN k < 90 THEN k END AS item_id,
       CASE WHEN k >= 90 THEN 'x' || CAST(k AS VARCHAR) END AS rejected_value,
       CASE WHEN k >= 90 THEN 'item_id' ELSE '' END AS bad_fields
FROM ev""",
    ),
    "write_read_roundtrip": _run(_NESTED_ROWS),
    "synthetic_feeds": _SYNTHETIC,
    "size_preview": _run(
        "SELECT ranking_id, customer_id, as_of_date, CAST(len(items) AS INTEGER) AS n_impr, "
        "CAST(len(actions) AS INTEGER) AS n_actions, "
        "CAST(len(action_types) AS INTEGER) AS n_action_types FROM run"
    ),
    "run_summary": _run(
        "SELECT count(*) AS rows, min(as_of_date) AS min_as_of_date, max(as_of_date) AS max_as_of_date, "
        "round(avg(len(items)), 6) AS avg_impressions_per_row, "
        "round(avg(len(actions)), 6) AS avg_actions_array_len FROM run"
    ),
    "padding_stats": _run(
        """SELECT round(avg(zeros), 6) AS avg_zero_pads_per_row,
       CAST(min(zeros) AS INTEGER) AS min_zero_pads_in_row,
       CAST(max(zeros) AS INTEGER) AS max_zero_pads_in_row
FROM (SELECT len(list_filter(action_types, lambda t: t = 0)) AS zeros FROM run)"""
    ),
    "sample_customers": _impressions(_PICKED_CUSTOMERS),
    "customer_snapshot": _run(
        f"""SELECT customer_id, count(*) AS rows, min(as_of_date) AS min_as_of_date,
       max(as_of_date) AS max_as_of_date, round(avg(len(items)), 6) AS avg_impr,
       round(avg(len(actions)), 6) AS avg_actions
FROM run WHERE customer_id IN ({_PICKED_CUSTOMERS}) GROUP BY customer_id"""
    ),
    "action_tokens": _run(
        f"""SELECT as_of_date, ranking_id, customer_id, CAST(len(actions) AS INTEGER) AS n_actions,
       array_to_string(list_transform(range(1, 6), lambda i:
         rpad(CAST(actions[i] AS VARCHAR) || ':' || {_name('action_types[i]')}, 12, ' ')), ' | ')
         AS actions_head
FROM run"""
    ),
    "action_names": _actions(
        f"SELECT {_name('action_type')} AS action_name, count(*) AS actions FROM acts GROUP BY 1"
    ),
    "sample_rows": _run(_NESTED_ROWS.replace("FROM run", f"FROM ({_PICKED_ROWS})")),
    "sample_items": _run(
        f"""SELECT as_of_date, ranking_id, customer_id,
       arg_min(item_id, draw) AS impression_item_id, arg_min(is_order, draw) AS is_order
FROM (SELECT *, md5('{SEED}|' || {_KEYS_TEXT} || '|' || CAST(pos AS VARCHAR)) AS draw
      FROM (SELECT *, unnest(items) AS item_id, unnest(flags) AS is_order,
                   unnest(range(len(items))) AS pos
            FROM ({_PICKED_ROWS})))
GROUP BY as_of_date, ranking_id, customer_id"""
    ),
    "pad_array": _impressions(
        "SELECT ranking_id, array_to_string(list_resize(items, 3, 0), ',') AS padded FROM impr"
    ),
}
