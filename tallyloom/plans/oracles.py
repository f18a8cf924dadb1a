"""Name -> DuckDB SQL for every activity query, written from the semantics, not from the DataFrames."""

from __future__ import annotations

from tallyloom.plans import records, runbook, scale

MODEL = """
WITH repos AS (
  SELECT n_nationkey::BIGINT AS repo_id, r_name AS owner, r_name || '/' || n_name AS full_name, CASE WHEN n_nationkey % 12 = 11 THEN 1 ELSE 0 END AS is_shallow
  FROM nation JOIN region ON n_regionkey = r_regionkey),
people AS (
  SELECT c_custkey AS identity_id, c_name AS login, c_nationkey::BIGINT AS repo_id, CASE WHEN c_mktsegment = 'MACHINERY' OR c_acctbal < -700 THEN 1 ELSE 0 END AS machine FROM customer),
spans AS (SELECT l_orderkey, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS agent FROM lineitem GROUP BY 1),
pe AS (
  SELECT o_orderkey AS pr_id, o.o_orderdate AS created_at, r.repo_id, r.full_name AS repo_full_name, r.owner, r.is_shallow,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS identity_id,
    CASE o_orderstatus WHEN 'F' THEN 'MERGED' WHEN 'O' THEN 'OPEN' ELSE 'CLOSED' END AS state, first_at,
    CASE WHEN o_orderstatus = 'F' THEN last_at END AS merged_at,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'bugfix' WHEN '2-HIGH' THEN 'feature' WHEN '3-MEDIUM' THEN 'chore' WHEN '5-LOW' THEN 'revert' ELSE 'unclassified' END AS class,
    CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' WHEN machine = 1 THEN 'machine' ELSE 'known' END AS steerer_state,
    coalesce(agent, 0) AS is_ai_assisted,
    CASE WHEN o_orderstatus = 'F' AND last_at IS NOT NULL THEN (epoch_us(last_at) - epoch_us(first_at)) / 3.6e9 END AS cycle_time_hours
  FROM orders o JOIN people p ON o_custkey = p.identity_id JOIN repos r ON r.repo_id = p.repo_id LEFT JOIN spans ON l_orderkey = o_orderkey),
latest AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem),
signed AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS sha, 'agent_' || (l_suppkey % 5) AS agent_key FROM lineitem WHERE l_returnflag = 'R'),
agents AS (SELECT sha, min(agent_key) AS agent_key FROM signed GROUP BY 1),
ce AS (
  SELECT pe.pr_id, pe.repo_id, pe.repo_full_name, pe.owner, pe.is_shallow, l_orderkey || '-' || l_linenumber AS sha, pe.identity_id, l_shipdate AS authored_at,
    l_shipdate::DATE AS day_start, date_trunc('week', l_shipdate)::DATE AS week_start, date_trunc('month', l_shipdate)::DATE AS month_start,
    CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS is_merge, l_quantity::DOUBLE AS insertions, CASE WHEN a.sha IS NULL THEN 0 ELSE 1 END AS is_ai_assisted, a.agent_key, pe.steerer_state
  FROM latest JOIN pe ON pe.pr_id = l_orderkey LEFT JOIN agents a ON a.sha = l_orderkey || '-' || l_linenumber WHERE rn = 1),
cc AS (SELECT * FROM ce WHERE steerer_state <> 'machine' AND is_shallow = 0 AND is_merge = 0),
mp AS (SELECT *, date_trunc('week', merged_at)::DATE AS merged_week, date_trunc('month', merged_at)::DATE AS merged_month FROM pe WHERE steerer_state <> 'machine' AND is_shallow = 0 AND state = 'MERGED' AND merged_at IS NOT NULL),
ccs AS (SELECT 'repo' AS scope, repo_full_name AS scope_key, * FROM cc UNION ALL SELECT 'org', owner, * FROM cc),
mps AS (SELECT 'repo' AS scope, repo_full_name AS scope_key, * FROM mp UNION ALL SELECT 'org', owner, * FROM mp),
firsts AS (SELECT scope, scope_key, identity_id, min(authored_at) AS first_at FROM ccs WHERE steerer_state = 'known' AND is_ai_assisted = 1 GROUP BY ALL)
"""

#: Sessions of incidents: a user's day.
SESSIONS = """
WITH s AS (SELECT user_id * 100 + extract(day FROM ts) AS session, count(*) AS turns, count(*) FILTER (event_type = 'click') AS actions, count(*) FILTER (event_type = 'view') AS verifications, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS recoveries,
  count(*) FILTER (event_type = 'error' AND value > 50) AS gaps, count(*) FILTER (event_type = 'click' AND value > 90) AS forced, count(*) FILTER (event_type = 'purchase') AS deploys FROM events GROUP BY 1),
i AS (
  SELECT session::BIGINT AS session, 'SV' AS code, actions || ' actions' AS evidence FROM s WHERE actions > 5 AND verifications = 0
  UNION ALL SELECT session, 'SF', errors || ' errors' FROM s WHERE errors >= 2 AND recoveries = 0
  UNION ALL SELECT session, 'UA', deploys || ' requests' FROM s WHERE deploys > 0 AND verifications = 0
  UNION ALL SELECT session, 'UB', forced || ' commands' FROM s WHERE forced > 0
  UNION ALL SELECT session, 'SG', gaps || ' errors' FROM s WHERE gaps > 0
  UNION ALL SELECT session, 'CF', turns || ' turns' FROM s WHERE turns >= 12)
"""

#: Findings of pages by plain text tests, good enough for well-formed pages; the codes of link targets are tested on a fixture.
FINDINGS = """
WITH f AS (
  SELECT page_id, 'High' AS severity, 'not-https' AS code FROM pages WHERE lower(url) NOT LIKE 'https://%'
  UNION ALL SELECT page_id, 'Medium', 'canonical-missing' FROM pages WHERE NOT regexp_matches(html, '<link[^>]*rel="canonical"')
  UNION ALL SELECT page_id, 'High', 'title-missing' FROM pages WHERE trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) = ''
  UNION ALL SELECT page_id, 'Medium', 'h1-count' FROM pages WHERE len(regexp_extract_all(html, '(?s)<h1[ >].*?</h1>')) <> 1
  UNION ALL SELECT page_id, 'Medium', 'html-lang-missing' FROM pages WHERE regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) = ''
  UNION ALL SELECT page_id, 'Medium', 'description-missing' FROM pages WHERE regexp_extract(html, '<meta[^>]*name="description"[^>]*content="([^"]*)"', 1) = ''
  UNION ALL SELECT page_id, 'Low', 'open-graph-incomplete' FROM pages WHERE regexp_extract(html, '<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1) = '' OR regexp_extract(html, '<meta[^>]*property="og:description"[^>]*content="([^"]*)"', 1) = ''
  UNION ALL SELECT page_id, 'Info', 'jsonld-static-missing' FROM pages WHERE NOT regexp_matches(html, '<script[^>]*type="application/ld\\+json"')
  UNION ALL SELECT page_id, 'High', 'canonical-multiple' FROM pages WHERE len(regexp_extract_all(html, '<link[^>]*rel="canonical"')) > 1
  UNION ALL SELECT page_id, 'Critical', 'noindex' FROM pages WHERE regexp_matches(lower(html), '<meta[^>]*name="robots"[^>]*noindex')
  UNION ALL SELECT page_id, 'Medium', 'image-alt-missing' FROM pages WHERE len(list_filter(regexp_extract_all(html, '<img[^>]*>'), lambda x: NOT contains(x, ' alt'))) > 0)
"""

COVERAGE = """
WITH c AS (SELECT extract(day FROM ts)::BIGINT AS run_id, CASE WHEN user_id % 2 = 0 THEN 'commit' ELSE 'pr' END AS unit_kind, CASE event_type WHEN 'error' THEN 'llm' WHEN 'view' THEN 'script-with-fallback' ELSE 'script' END AS method, CASE WHEN value > 50 THEN event_type END AS detail FROM events)
"""

DAILY = "SELECT ts::DATE AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY ALL"

RATIOS = """
w AS (SELECT scope, scope_key, merged_week AS period_start, count(*) AS merged, count(*) FILTER (class <> 'unclassified') AS classified, count(*) FILTER (class = 'bugfix') AS bugfix, count(*) FILTER (class = 'revert') AS reverts, count(*) FILTER (class = 'feature') AS feature,
  count(*) FILTER (is_ai_assisted = 1) AS assisted, count(*) FILTER (class = 'unclassified') AS unclassified, count(*) FILTER (steerer_state = 'unknown') AS unknown FROM mps GROUP BY ALL),
m AS (SELECT scope, scope_key, period_start, 'quality.defect_ratio' AS metric_key, bugfix AS numerator, classified AS denominator FROM w
  UNION ALL SELECT scope, scope_key, period_start, 'quality.revert_rate', reverts, classified FROM w UNION ALL SELECT scope, scope_key, period_start, 'impact.innovation_ratio', feature, classified FROM w
  UNION ALL SELECT scope, scope_key, period_start, 'adoption.ai_pr_share', assisted, merged FROM w UNION ALL SELECT scope, scope_key, period_start, 'meta.unclassified_pr_share', unclassified, merged FROM w
  UNION ALL SELECT scope, scope_key, period_start, 'meta.unknown_steerer_pr_share', unknown, merged FROM w)
SELECT m.scope, m.scope_key, m.period_start, metric_key, numerator, denominator, round(100.0::DOUBLE * numerator / nullif(denominator, 0), 6) AS value, denominator AS sample_size,
  CASE WHEN unclassified > 0 AND (metric_key LIKE 'quality.%' OR metric_key LIKE 'impact.%') THEN unclassified || ' unclassified' END AS note
FROM m JOIN w ON m.scope = w.scope AND m.scope_key = w.scope_key AND m.period_start = w.period_start
UNION ALL SELECT scope, scope_key, period_start, u.k, NULL, NULL, NULL, NULL, u.why FROM w, (VALUES ('effectiveness.dxi', 'unavailable: taken from a survey, not from activity'), ('risk.ownership_concentration', 'unavailable: defined by file path, and paths are not read')) u(k, why)
"""

COMMIT_METRICS = """
w AS (SELECT scope, scope_key, week_start AS period_start, count(*) AS commits, count(*) FILTER (is_ai_assisted = 1) AS agent, count(*) FILTER (steerer_state = 'known') AS known, count(*) FILTER (steerer_state = 'known' AND is_ai_assisted = 1) AS known_agent, count(*) FILTER (is_ai_assisted = 0) AS unknown_exec,
  count(*) FILTER (steerer_state <> 'known') AS unknown, count(DISTINCT CASE WHEN steerer_state = 'known' THEN identity_id END) AS steerers, count(DISTINCT identity_id) AS contributors, count(DISTINCT CASE WHEN is_ai_assisted = 1 THEN identity_id END) AS with_agent FROM ccs GROUP BY ALL),
m AS (SELECT scope, scope_key, period_start, 'adoption.ai_commit_share' AS metric_key, agent AS numerator, commits AS denominator, 100.0::DOUBLE AS s FROM w
  UNION ALL SELECT scope, scope_key, period_start, 'adoption.ai_commit_share_known_steerer', known_agent, known, 100.0 FROM w UNION ALL SELECT scope, scope_key, period_start, 'adoption.executor_unknown_share', unknown_exec, commits, 100.0 FROM w
  UNION ALL SELECT scope, scope_key, period_start, 'adoption.contributors_with_ai_share', with_agent, contributors, 100.0 FROM w UNION ALL SELECT scope, scope_key, period_start, 'leverage.commits_per_steerer', known, steerers, 1.0 FROM w
  UNION ALL SELECT scope, scope_key, period_start, 'meta.unknown_steerer_share', unknown, commits, 100.0 FROM w UNION ALL SELECT scope, scope_key, period_start, 'meta.identity_resolution_pct', known, commits, 100.0 FROM w)
SELECT m.scope, m.scope_key, m.period_start, metric_key, numerator, denominator, round(s * numerator / nullif(denominator, 0), 6) AS value, denominator AS sample_size,
  CASE WHEN unknown > 0 AND metric_key IN ('adoption.ai_commit_share_known_steerer', 'leverage.commits_per_steerer') THEN unknown || ' without a known steerer' END AS note
FROM m JOIN w ON m.scope = w.scope AND m.scope_key = w.scope_key AND m.period_start = w.period_start
"""

#: Changes of personal median cycle times, with DAYS on each side and LEAST reviews.
CYCLE_DELTA = """, u AS (SELECT max(authored_at)::DATE AS last_day FROM cc), f AS (SELECT firsts.* FROM firsts, u WHERE first_at::DATE + DAYS <= last_day),
  p AS (SELECT f.scope, f.scope_key, f.identity_id, count(*) FILTER (merged_at < f.first_at) AS bn, count(*) FILTER (merged_at >= f.first_at) AS an, quantile_cont(CASE WHEN merged_at < f.first_at THEN cycle_time_hours END, 0.5) AS bp, quantile_cont(CASE WHEN merged_at >= f.first_at THEN cycle_time_hours END, 0.5) AS ap
    FROM f JOIN mps c ON c.scope = f.scope AND c.scope_key = f.scope_key AND c.identity_id = f.identity_id AND c.steerer_state = 'known' AND cycle_time_hours IS NOT NULL AND merged_at >= f.first_at - INTERVAL DAYS DAY AND merged_at < f.first_at + INTERVAL DAYS DAY GROUP BY ALL)
SELECT scope, scope_key, count(*) AS people, round(quantile_cont(100.0::DOUBLE * (ap - bp) / bp, 0.5), 6) AS median_delta_pct FROM p WHERE bn >= LEAST AND an >= LEAST AND bp > 0 GROUP BY ALL"""

CI = """
WITH l AS (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 'r': l_returnflag, 's': l_linestatus} ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS ls FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS k, coalesce(ls, []) AS ls FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
t AS (SELECT k, ls, len(ls) AS runs, list_contains(list_transform(ls, lambda x: x.n), 1) AS has1,
  list_filter(ls, lambda x: (x.s = 'O' AND x.p % 2 = 0) OR x.r = 'R')[1] AS bad FROM b),
v AS (SELECT CASE
    WHEN k % 11 = 0 THEN 'block|check_runs lookup failed' WHEN k % 13 = 0 THEN 'block|commit_statuses lookup failed'
    WHEN k % 3 = 0 AND NOT has1 THEN 'block|expected check missing: check-1'
    WHEN runs = 0 AND k % 4 <> 0 AND k % 3 = 0 THEN 'block|no check runs returned despite configured expected check'
    WHEN runs = 0 AND k % 4 <> 0 AND k % 2 = 0 THEN 'block|no check runs returned despite configured pull-request workflow'
    WHEN runs = 0 AND k % 4 <> 0 THEN 'na|no CI configured'
    WHEN bad.s = 'O' AND bad.p % 2 = 0 THEN 'block|check pending: check-' || bad.n
    WHEN bad.n IS NOT NULL THEN 'block|check not successful: check-' || bad.n
    WHEN k % 4 = 0 AND k % 8 <> 0 THEN 'block|commit status not successful: lint'
    ELSE 'pass|all observed checks successful' END AS x FROM t)
SELECT split_part(x, '|', 1) AS classification, split_part(x, '|', 2) AS reason, count(*) AS prs FROM v GROUP BY ALL
"""

CLASSIFY = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 10 AS t, o_orderkey % 7 AS l, o_orderkey % 11 AS h, o_orderkey % 1000 AS n, o_orderkey % 5 = 0 AS issue FROM orders),
-- the composed vocabulary, by index: what each title, label list and branch says
x AS (SELECT k, t, l, h, n, issue,
  CASE l WHEN 1 THEN 'bugfix' WHEN 2 THEN 'feature' WHEN 5 THEN 'docs' END AS label_class, CASE l WHEN 1 THEN 'bug' WHEN 2 THEN 'enhancement' WHEN 5 THEN 'docs' END AS label,
  CASE h WHEN 1 THEN 'feature' WHEN 2 THEN 'bugfix' WHEN 9 THEN 'chore' END AS branch_class, CASE h WHEN 1 THEN 'feature' WHEN 2 THEN 'hotfix' WHEN 9 THEN 'release' END AS branch FROM o),
r AS (SELECT k, CASE
  WHEN t = 3 THEN 'revert|revert:title|script|1|0.95'
  WHEN h = 7 THEN 'deps|deps:head-branch|script|0|0.95'
  WHEN t = 2 THEN 'deps|deps:cc-scope|script|0|0.95'
  WHEN t = 0 THEN 'feature|cc:feat|script|0|0.95'
  WHEN t = 5 THEN 'docs|cc:docs|script|0|0.95'
  WHEN t = 6 THEN 'chore|release:title|script-with-fallback|0|0.7'
  WHEN h = 9 THEN 'chore|release:head-branch|script-with-fallback|0|0.75'
  WHEN label IS NOT NULL THEN label_class || '|label:' || label || '|script-with-fallback|0|0.8'
  WHEN branch IS NOT NULL THEN branch_class || '|branch:' || branch || '|script-with-fallback|0|0.7'
  WHEN h = 3 THEN 'chore|release:promotion|script-with-fallback|0|0.6'
  WHEN t = 1 THEN 'bugfix|verb:fix|script-with-fallback|0|0.55'
  WHEN t = 7 THEN 'feature|verb:add|script-with-fallback|0|0.55'
  ELSE 'unclassified|' || CASE WHEN t = 8 THEN 'unmapped-cc-prefix(wip)' ELSE 'no-cc-prefix' END || '+' || CASE WHEN l = 3 THEN 'label-conflict' WHEN l IN (0, 6) THEN 'no-labels' ELSE 'no-mapped-label' END
    || '+' || CASE WHEN h = 4 THEN 'no-head-ref' ELSE 'no-branch-pattern' END || '+no-title-verb' || CASE WHEN issue THEN '+has-issue-link' ELSE '' END || '|llm|0|' END AS x FROM x)
SELECT split_part(x, '|', 1) AS class, split_part(x, '|', 2) AS reason, split_part(x, '|', 3) AS method, count(*) AS prs, sum(split_part(x, '|', 4)::INT)::BIGINT AS reverts, sum(CASE WHEN split_part(x, '|', 5) = '' THEN NULL WHEN split_part(x, '|', 5)::DOUBLE < 0.7 THEN 1 ELSE 0 END)::BIGINT AS weak, min(k) AS first_pr FROM r GROUP BY ALL
"""

UPSERTS = """
WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS price, 'old' AS note FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), w AS (SELECT o_custkey AS k, max(CASE WHEN o_totalprice > 200000 THEN o_totalprice END) AS price, 'new' AS note FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
b AS (SELECT coalesce(o.k, w.k) AS k, o.price AS op, w.price AS wp, o.note AS onote, w.note AS wnote FROM o FULL JOIN w ON o.k = w.k)
SELECT 'preserving/' || coalesce(onote, wnote, 'none') AS step, count(*) AS keys, round(sum(coalesce(wp, op)), 2) AS price FROM b GROUP BY 1
UNION ALL SELECT 'if_absent/' || coalesce(onote, wnote), count(*), round(sum(CASE WHEN onote IS NULL THEN wp ELSE op END), 2) FROM b GROUP BY 1
UNION ALL SELECT 'lowest', count(*), round(sum(least(op, wp)), 2) FROM b UNION ALL SELECT 'accumulated', count(*), round(sum(coalesce(op, 0) + coalesce(wp, 0)), 2) FROM b
"""

SQL = {
    "q01_weekly_delivery": MODEL
    + """, r AS (SELECT scope, scope_key, merged_week AS week_start, count(*) AS prs_merged, count(DISTINCT identity_id) AS active_contributors, round(quantile_cont(cycle_time_hours, 0.5), 6) AS cycle_p50, round(quantile_disc(cycle_time_hours, 0.75), 6) AS cycle_p75 FROM mps GROUP BY ALL),
  d AS (SELECT * FROM (SELECT DISTINCT scope, scope_key FROM r), (SELECT unnest(generate_series((SELECT min(week_start) FROM r), (SELECT max(week_start) FROM r), INTERVAL 7 DAY))::DATE AS week_start))
SELECT scope, scope_key, week_start, coalesce(prs_merged, 0) AS prs_merged, coalesce(active_contributors, 0) AS active_contributors, cycle_p50, cycle_p75 FROM d LEFT JOIN r USING (scope, scope_key, week_start)""",
    "q02_commits_enriched": MODEL
    + "SELECT repo_full_name, owner, sha, identity_id, day_start, week_start, month_start, is_merge::BIGINT AS is_merge, is_ai_assisted::BIGINT AS is_ai_assisted, CASE WHEN identity_id IS NULL THEN 1 ELSE 0 END::BIGINT AS is_unattributed, steerer_state, CASE WHEN is_ai_assisted = 1 THEN 'agent' ELSE 'unknown' END AS executor_state, agent_key AS executor_agent_key, insertions FROM ce",
    "q03_prs_enriched": MODEL
    + "SELECT pr_id, repo_full_name, owner, identity_id, state, merged_at::DATE AS merged_day_start, date_trunc('week', merged_at)::DATE AS merged_week_start, date_trunc('month', merged_at)::DATE AS merged_month_start, round(cycle_time_hours, 6) AS cycle_time_hours, class, CASE WHEN class = 'revert' THEN 1 ELSE 0 END::BIGINT AS is_revert, is_ai_assisted::BIGINT AS is_ai_assisted, steerer_state, CASE WHEN is_ai_assisted = 1 THEN 'agent' ELSE 'unknown' END AS executor_state FROM pe",
    "q04_period_pivot": MODEL
    + ", p AS (SELECT 'day' AS period_kind, day_start AS period_start, * FROM cc UNION ALL SELECT 'week', week_start, * FROM cc UNION ALL SELECT 'month', month_start, * FROM cc) SELECT period_kind, period_start, repo_full_name, count(*) AS commits, count(DISTINCT identity_id) AS authors FROM p GROUP BY ALL",
    "q05_cycle_percentiles": MODEL + "SELECT scope, scope_key, merged_month AS month_start, count(*) AS n, round(quantile_cont(cycle_time_hours, 0.5), 6) AS p50, round(quantile_disc(cycle_time_hours, 0.75), 6) AS p75 FROM mps WHERE cycle_time_hours IS NOT NULL GROUP BY ALL",
    "q06_bus_factor": MODEL
    + """, p AS (SELECT scope, scope_key, month_start, identity_id, count(*) AS n FROM ccs WHERE identity_id IS NOT NULL GROUP BY ALL),
  k AS (SELECT *, row_number() OVER w AS rk, sum(n) OVER (PARTITION BY scope, scope_key, month_start ORDER BY n DESC, identity_id ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY scope, scope_key, month_start) AS tot FROM p WINDOW w AS (PARTITION BY scope, scope_key, month_start ORDER BY n DESC, identity_id))
SELECT scope, scope_key, month_start, min(CASE WHEN cum * 2 >= tot THEN rk END) AS bus_factor, round(max(CASE WHEN rk = 1 THEN 100.0::DOUBLE * n / tot END), 6) AS top_share, max(tot)::BIGINT AS commits FROM k GROUP BY ALL""",
    "q07_agent_mix": MODEL
    + """, n AS (SELECT scope, scope_key, week_start, s.agent_key, count(DISTINCT ccs.sha) AS n FROM ccs JOIN signed s ON s.sha = ccs.sha GROUP BY ALL), t AS (SELECT scope, scope_key, week_start, count(*) AS total FROM ccs WHERE is_ai_assisted = 1 GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY scope, scope_key, week_start ORDER BY n DESC, agent_key) AS rk FROM n)
SELECT scope, scope_key, week_start, agent_key, n AS commits, round(100.0::DOUBLE * n / total, 6) AS share FROM k JOIN t USING (scope, scope_key, week_start) WHERE rk = 1""",
    "q08_agent_share": MODEL
    + ", n AS (SELECT scope, scope_key, week_start, s.agent_key, count(DISTINCT ccs.sha) AS n FROM ccs JOIN signed s ON s.sha = ccs.sha GROUP BY ALL), t AS (SELECT scope, scope_key, week_start, count(*) AS total FROM ccs WHERE is_ai_assisted = 1 GROUP BY ALL) SELECT scope, scope_key, week_start, agent_key, n AS numerator, total AS denominator, round(100.0::DOUBLE * n / total, 6) AS value FROM n JOIN t USING (scope, scope_key, week_start)",
    "q09_ratio_metrics": MODEL + ", " + RATIOS,
    "q09b_commit_metrics": MODEL + ", " + COMMIT_METRICS,
    "q09c_throughput": MODEL
    + """, f AS (SELECT * FROM pe WHERE steerer_state <> 'machine' AND is_shallow = 0), fs AS (SELECT 'repo' AS scope, repo_full_name AS scope_key, * FROM f UNION ALL SELECT 'org', owner, * FROM f),
  o AS (SELECT scope, scope_key, date_trunc('week', created_at)::DATE AS week_start, count(*) AS prs_opened FROM fs GROUP BY ALL),
  m AS (SELECT scope, scope_key, merged_week AS week_start, count(*) AS prs_merged, count(DISTINCT identity_id) AS contributors, count(DISTINCT CASE WHEN steerer_state = 'known' THEN identity_id END) AS steerers, count(*) FILTER (steerer_state = 'known') AS known FROM mps GROUP BY ALL)
SELECT scope, scope_key, week_start, coalesce(prs_opened, 0) AS prs_opened, coalesce(prs_merged, 0) AS prs_merged, coalesce(contributors, 0) AS contributors, coalesce(steerers, 0) AS steerers, round(prs_merged::DOUBLE / nullif(contributors, 0), 6) AS throughput, round(known::DOUBLE / nullif(steerers, 0), 6) AS prs_per_steerer FROM o FULL JOIN m USING (scope, scope_key, week_start)""",
    "q10_attribution_pair": MODEL
    + "SELECT owner, count(*) FILTER (steerer_state = 'known' AND is_ai_assisted = 1) AS known_agent, count(*) FILTER (steerer_state = 'known' AND is_ai_assisted = 0) AS known_unknown, count(*) FILTER (steerer_state = 'unknown' AND is_ai_assisted = 1) AS unknown_agent, count(*) FILTER (steerer_state = 'unknown' AND is_ai_assisted = 0) AS unknown_unknown, count(*) FILTER (steerer_state = 'machine') AS machine, count(*) AS commits, count(DISTINCT CASE WHEN steerer_state = 'known' AND is_ai_assisted = 1 THEN identity_id END) AS people_with_agents FROM ce WHERE is_merge = 0 AND is_shallow = 0 GROUP BY 1",
    "q11_adopters_cumulative": MODEL
    + """, a AS (SELECT scope, scope_key, date_trunc('month', first_at)::DATE AS month_start FROM firsts), d AS (SELECT * FROM (SELECT DISTINCT scope, scope_key FROM a), (SELECT unnest(generate_series((SELECT min(month_start) FROM a), (SELECT max(month_start) FROM a), INTERVAL 1 MONTH))::DATE AS month_start))
SELECT scope, scope_key, month_start, (SELECT count(*) FROM a WHERE a.scope = d.scope AND a.scope_key = d.scope_key AND a.month_start = d.month_start) AS new_adopters, (SELECT count(*) FROM a WHERE a.scope = d.scope AND a.scope_key = d.scope_key AND a.month_start <= d.month_start) AS adopters FROM d""",
    "q12_before_after_volume": MODEL
    + """, u AS (SELECT max(authored_at)::DATE AS last_day FROM cc), f AS (SELECT firsts.* FROM firsts, u WHERE first_at::DATE + 90 <= last_day),
  p AS (SELECT f.scope, f.scope_key, f.identity_id, count(*) FILTER (authored_at < first_at) AS b, count(*) FILTER (authored_at >= first_at) AS a FROM f JOIN ccs c ON c.scope = f.scope AND c.scope_key = f.scope_key AND c.identity_id = f.identity_id AND c.steerer_state = 'known' AND authored_at >= first_at - INTERVAL 90 DAY AND authored_at < first_at + INTERVAL 90 DAY GROUP BY ALL)
SELECT scope, scope_key, count(*) AS people, round(quantile_cont(100.0::DOUBLE * (a - b) / b, 0.5), 6) AS median_delta_pct, sum(b)::BIGINT AS commits_before, sum(a)::BIGINT AS commits_after FROM p WHERE b > 0 GROUP BY ALL""",
    "q13_before_after_cycle": MODEL + CYCLE_DELTA.replace("DAYS", "90").replace("LEAST", "3"),
    "q13b_cycle_after_adoption": MODEL + CYCLE_DELTA.replace("DAYS", "730").replace("LEAST", "1"),
    "q13c_first_trailer_dates": MODEL
    + ", s AS (SELECT scope, scope_key, authored_at, agent_key, row_number() OVER (PARTITION BY scope, scope_key ORDER BY authored_at, agent_key) AS rk FROM ccs WHERE is_ai_assisted = 1) SELECT scope, scope_key, authored_at::DATE AS first_ai_trailer_date, agent_key FROM s WHERE rk = 1",
    "q14_author_period": MODEL
    + """, c AS (SELECT identity_id, repo_full_name, week_start, count(*) AS commits, sum(insertions) AS insertions, count(*) FILTER (is_ai_assisted = 1) AS ai_commits FROM cc WHERE identity_id IS NOT NULL GROUP BY ALL), p AS (SELECT identity_id, repo_full_name, merged_week AS week_start, count(*) AS prs_merged FROM mp WHERE identity_id IS NOT NULL GROUP BY ALL)
SELECT identity_id, repo_full_name, week_start, coalesce(commits, 0) AS commits, coalesce(ai_commits, 0) AS ai_commits, coalesce(prs_merged, 0) AS prs_merged, coalesce(insertions, 0.0) AS insertions FROM c FULL JOIN p USING (identity_id, repo_full_name, week_start)""",
    "q15_spine_dense": MODEL
    + ", r AS (SELECT repo_full_name, month_start, count(*) AS commits FROM cc GROUP BY ALL), d AS (SELECT full_name AS repo_full_name, month_start FROM repos, (SELECT unnest(generate_series((SELECT min(month_start) FROM r), (SELECT max(month_start) FROM r), INTERVAL 1 MONTH))::DATE AS month_start) WHERE is_shallow = 0) SELECT repo_full_name, month_start, coalesce(commits, 0) AS commits FROM d LEFT JOIN r USING (repo_full_name, month_start)",
    "q16_top_n_fold": MODEL
    + ", g AS (SELECT owner, repo_full_name, count(*) AS prs FROM mp GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY prs DESC, repo_full_name) AS rk FROM g) SELECT owner, CASE WHEN rk <= 3 THEN repo_full_name ELSE 'OTHER' END AS panel, sum(prs)::BIGINT AS prs, count(*) AS repos FROM v GROUP BY ALL",
    "q17_change_table": MODEL
    + """, b AS (SELECT min(merged_week) AS lo, date_trunc('week', max(merged_at))::DATE AS cur FROM mp), h AS (SELECT repo_full_name, (merged_week - lo) / 7 >= floor((cur - lo) / 7 / 2) AS late FROM mp, b WHERE merged_week < cur), p AS (SELECT repo_full_name, count(*) FILTER (NOT late) AS earlier, count(*) FILTER (late) AS later FROM h GROUP BY 1)
SELECT repo_full_name, earlier, later, CASE WHEN earlier = 0 THEN 'new' WHEN later > earlier THEN 'up' WHEN later < earlier THEN 'down' ELSE 'flat' END AS trend, round(100.0::DOUBLE * (later - earlier) / nullif(earlier, 0), 6) AS change_pct FROM p""",
    "q18_precision_recall": MODEL
    + ", p AS (SELECT owner, count(*) FILTER (insertions >= 25 AND is_ai_assisted = 1) AS tp, count(*) FILTER (insertions >= 25 AND is_ai_assisted = 0) AS fp, count(*) FILTER (insertions < 25 AND is_ai_assisted = 1) AS fn, count(*) AS n FROM cc GROUP BY 1) SELECT owner, tp, fp, fn, n, round(100.0::DOUBLE * tp / nullif(tp + fp, 0), 6) AS precision, round(100.0::DOUBLE * tp / nullif(tp + fn, 0), 6) AS recall, round(100.0::DOUBLE * (tp + fn) / nullif(n, 0), 6) AS base_rate FROM p",
    "q19_iso_week_series": MODEL + "SELECT strftime(week_start, '%G-W%V') AS iso_week, count(*) AS commits, count(DISTINCT identity_id) AS authors FROM cc GROUP BY 1",
    "q20_cohort_suppression": MODEL
    + ", p AS (SELECT repo_full_name, month_start, count(DISTINCT identity_id) AS d, count(DISTINCT CASE WHEN is_ai_assisted = 1 THEN identity_id END) AS n FROM cc WHERE identity_id IS NOT NULL GROUP BY ALL) SELECT repo_full_name, month_start, CASE WHEN d >= 5 THEN n END AS numerator, d AS denominator, CASE WHEN d >= 5 THEN round(100.0::DOUBLE * n / d, 6) END AS value, nullif(concat_ws('; ', CASE WHEN d < 5 THEN 'suppressed: cohort below floor' END, CASE WHEN n = 0 THEN 'no adopter' END), '') AS note FROM p",
    "q21_orphan_prs": MODEL + "SELECT pr_id, repo_id, identity_id FROM pe WHERE state = 'MERGED' AND NOT EXISTS (SELECT 1 FROM ce WHERE ce.pr_id = pe.pr_id)",
    "q22_in_subquery": MODEL + "SELECT repo_id, count(*) AS commits, count(DISTINCT pr_id) AS prs FROM ce WHERE repo_id IN (SELECT repo_id FROM ce GROUP BY 1 HAVING avg(insertions) > 25.5) AND (repo_id, pr_id) IN (SELECT repo_id, pr_id FROM pe WHERE state = 'OPEN') GROUP BY 1",
    "q23_upsert_latest": "WITH v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem) SELECT l_linenumber::BIGINT AS l_linenumber, count(*) AS keys, round(sum(l_quantity), 2) AS quantity, max(l_shipdate)::DATE AS last_seen, sum(l_partkey)::BIGINT AS parts FROM v WHERE rn = 1 GROUP BY 1",
    "q23b_upserts": UPSERTS,
    "q24_affected_buckets": "SELECT DISTINCT ts::DATE AS day FROM events WHERE event_id % 14 = 0 UNION SELECT day FROM (SELECT DISTINCT ts::DATE AS day FROM events ORDER BY day DESC LIMIT 2)",
    "q25_incremental_equals_full": DAILY,
    "q26_bucket_property_check": "SELECT d AS day, date_trunc('week', d)::DATE AS week_start, 1::BIGINT AS holds FROM (SELECT unnest(generate_series(DATE '2026-01-01', DATE '2026-01-21', INTERVAL 1 DAY))::DATE AS d UNION SELECT ts::DATE FROM events)",
    "q26b_bucket_mismatches": "SELECT 0::BIGINT AS mismatches, count(*) AS rows_checked FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)",
    "q27_conservation": MODEL + "SELECT 'day_start' AS period, count(*) AS total, count(DISTINCT day_start) AS buckets FROM cc UNION ALL SELECT 'week_start', count(*), count(DISTINCT week_start) FROM cc UNION ALL SELECT 'month_start', count(*), count(DISTINCT month_start) FROM cc",
    "q28_classify_titles": CLASSIFY,
    "q29_pattern_first_match": "SELECT CASE WHEN regexp_matches(t, 'brass|steel|tin') THEN 'metal' WHEN regexp_matches(t, '^[a-f]') THEN 'early' WHEN regexp_matches(t, 'promo') THEN 'promo' WHEN regexp_matches(t, '[aeiou]{2}') THEN 'vowel' ELSE 'other' END AS hit, count(*) AS parts, round(avg(p_retailprice), 4) AS avg_price FROM (SELECT lower(p_name || ' ' || p_type) AS t, p_retailprice FROM part) GROUP BY 1",
    "q30_body_measure": """WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10))[2:], lambda x: regexp_replace(x, '[ \\t\\r]+$', '')), lambda x: x <> '' AND NOT regexp_matches(x, '^[ \\t]*[A-Za-z-]+:[ \\t]')) AS b FROM documents)
SELECT doc_id, (coalesce(list_sum(list_transform(b, lambda x: length(x))), 0) > 0)::BIGINT AS has_body, coalesce(list_sum(list_transform(b, lambda x: length(x))), 0)::BIGINT AS body_chars, least(length(text), 80)::BIGINT AS subject_chars FROM l""",
    "q31_pii_scan": "WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -item_id - 1, text FROM benchmark) SELECT doc_id, 'email-shaped' AS found FROM d WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') UNION ALL SELECT doc_id, lower(n_name) FROM d, nation WHERE contains(lower(text), lower(n_name))",
    "q32_page_findings": FINDINGS + "SELECT page_id, severity, code FROM f",
    "q32b_page_findings_all": FINDINGS + "SELECT page_id, url, severity, code, CASE code WHEN 'not-https' THEN url WHEN 'h1-count' THEN len(regexp_extract_all(html, '(?s)<h1[ >].*?</h1>'))::VARCHAR ELSE '' END AS evidence FROM f JOIN pages USING (page_id)",
    "q32c_crawl_frontier": """WITH p AS (SELECT regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS root, regexp_replace(CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*$') THEN url || '/' ELSE url END, '#.*$', '') AS url, html FROM pages),
  l AS (SELECT DISTINCT root || h AS link FROM (SELECT root, unnest(regexp_extract_all(html, '<a [^>]*href="(/[^"#]*)', 1)) AS h FROM p))
SELECT link FROM l WHERE link NOT IN (SELECT url FROM p)""",
    "q33_session_signals": "SELECT conv_id AS session, count(*) AS turns, count(*) FILTER (role = 'assistant') AS actions, count(*) FILTER (role = 'assistant' AND regexp_matches(lower(text), 'curl|gh pr view')) AS verifications, count(*) FILTER (regexp_matches(lower(text), 'error|fail')) AS errors, count(*) FILTER (regexp_matches(lower(text), '--force|--no-verify|--skip|-f ')) AS forced, sum(length(text))::BIGINT AS chars, length(arg_min(text, (turn, text)) FILTER (role = 'user'))::BIGINT AS prompt_chars FROM conversations GROUP BY 1",
    "q34_incident_taxonomy": SESSIONS + "SELECT session, code, evidence FROM i",
    "q35_recurrence": SESSIONS + ", k AS (SELECT *, (session // 100) % 10 AS g, row_number() OVER (PARTITION BY (session // 100) % 10, code ORDER BY length(evidence) DESC, session) AS rk, count(*) OVER (PARTITION BY (session // 100) % 10, code) AS n FROM i) SELECT g::BIGINT AS user_group, code, n AS incidents, evidence AS exemplar, session FROM k WHERE rk = 1 AND n >= 3",
    "q35b_incident_trend": SESSIONS + ", c AS (SELECT code, count(*) FILTER (session % 100 BETWEEN 15 AND 21) AS current, count(*) FILTER (session % 100 BETWEEN 8 AND 14) AS prior FROM i GROUP BY 1) SELECT code, current, prior, CASE WHEN current < prior THEN 'improving' WHEN current > prior THEN 'worsening' ELSE 'stable' END AS trend FROM c WHERE current + prior > 0",
    "q36_severity_histogram": FINDINGS + ", s AS (SELECT * FROM (VALUES ('Critical', 1), ('High', 2), ('Medium', 3), ('Low', 4), ('Info', 5)) v(severity, rank)) SELECT s.severity, s.rank::BIGINT AS rank, count(f.code) AS findings, count(DISTINCT page_id) AS pages FROM s LEFT JOIN f USING (severity) GROUP BY ALL",
    "q37_ci_verdict": CI,
    "q37b_head_decisions": "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'promote' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'restart' ELSE 'blocked' END ELSE 'blocked' END AS decision, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'auto' ELSE 'manual' END AS authority, count(*) AS prs FROM orders GROUP BY ALL",
    "q38_risk_matrix": """WITH p AS (SELECT ['critical', 'high', 'medium', 'low'][(p_partkey % 4 + 1)::INT] AS s, CASE WHEN p_size % 2 = 0 THEN 'net' WHEN p_size % 3 = 0 THEN 'test' ELSE 'dev' END AS e, ['patch', 'minor', 'major'][p_size % 3 + 1] AS b, p_partkey % 2 = 0 AS direct, p_size % 2 = 0 AS runtime, p_partkey FROM part),
  r AS (SELECT *, CASE WHEN p_partkey % 50 = 0 OR (b = 'major' AND direct AND runtime) THEN 'High' WHEN b = 'major' OR (b = 'minor' AND direct) THEN 'Medium' ELSE 'Low' END AS risk FROM p)
SELECT CASE WHEN s = 'critical' AND e = 'net' THEN 'P0' WHEN (s = 'critical' AND e = 'dev') OR (s = 'high' AND e = 'net') THEN 'P1' WHEN s = 'critical' OR s = 'high' OR (s = 'medium' AND e = 'net') THEN 'P2' WHEN s = 'medium' OR e = 'net' THEN 'backlog' ELSE 'dismiss' END AS priority, risk,
  CASE WHEN p_partkey % 10 = 1 OR p_partkey % 15 = 2 OR risk = 'High' THEN 'flag' WHEN risk = 'Medium' AND direct THEN 'write-tests' ELSE 'auto-merge' END AS action, count(*) AS alerts FROM r GROUP BY ALL""",
    "q38b_readiness": """WITH d AS (SELECT s_suppkey AS k, s_suppkey % 3 <> 0 AS w, (k*3)%11 AS env, (k*4)%11 AS tests, (k*5)%11 AS ctx, (k*6)%11 AS ci, (k*7)%11 AS tasks, (k*8)%11 AS sec, (k*9)%11 AS wiring, (k*10)%11 AS health FROM supplier),
  s AS (SELECT k, (env*20 + tests*(CASE WHEN w THEN 25 ELSE 30 END) + ctx*15 + ci*10 + tasks*10 + sec*10 + wiring*(CASE WHEN w THEN 5 ELSE 0 END) + health*5) / 100.0::DOUBLE AS score, ceil(k % 4 + (k % 3) * 0.5) AS g FROM d)
SELECT k AS s_suppkey, round(score, 6) AS score, CASE WHEN score >= 8 THEN 'READY' WHEN score >= 6 THEN 'NEARLY READY' WHEN score >= 4 THEN 'NEEDS WORK' ELSE 'NOT READY' END AS tier, CASE WHEN k % 7 = 0 THEN 'F' WHEN g = 0 THEN 'A' WHEN g = 1 THEN 'B' WHEN g = 2 THEN 'C' ELSE 'D' END AS grade FROM s""",
    "q39_glob_join": """WITH p AS (SELECT p_partkey, p_type AS t, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
  h AS (SELECT p_partkey, 1 AS o, 'ring' AS rule FROM p WHERE b = 'ring' UNION ALL SELECT p_partkey, 2, 'small' FROM p WHERE t = 'SMALL' UNION ALL SELECT p_partkey, 3, 'warm' FROM p WHERE a = 'hot' OR (t = 'PROMO' AND b = 'gizmo') UNION ALL SELECT p_partkey, 5, 'any' FROM p)
SELECT rule, count(*) AS paths, count(*) FILTER (o = first_o) AS first_hits FROM (SELECT *, min(o) OVER (PARTITION BY p_partkey) AS first_o FROM h) GROUP BY 1""",
    "q40_cooccurrence": "WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS together FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL HAVING count(*) >= 3",
    "q41_hotspots": "SELECT l_partkey, count(*) AS churn, count(DISTINCT l_suppkey) AS authors, max(p_size)::BIGINT AS size, round(count(*) * max(p_size)::DOUBLE, 6) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY score DESC, l_partkey LIMIT 50",
    "q43_envelope_counters": MODEL
    + "SELECT * FROM (SELECT count(*) AS commits, count(*) FILTER (is_merge = 1) AS merges, count(*) FILTER (steerer_state = 'machine') AS machine_commits, count(*) FILTER (identity_id IS NULL) AS unattributed, count(*) FILTER (is_shallow = 1) AS in_shallow, count(*) FILTER (is_ai_assisted = 1) AS assisted, min(day_start) AS first_day, max(day_start) AS last_day FROM ce), (SELECT count(*) AS prs, count(*) FILTER (state = 'MERGED') AS merged, count(*) FILTER (class = 'unclassified') AS unclassified, count(*) FILTER (state = 'MERGED' AND cycle_time_hours IS NULL) AS no_cycle_time FROM pe)",
    "q43b_excluded_actors": MODEL + "SELECT (SELECT count(*) FROM ce WHERE is_merge = 0 AND steerer_state = 'machine') AS bot_commits, (SELECT count(*) FROM pe WHERE steerer_state = 'machine' AND state = 'MERGED' AND merged_at IS NOT NULL) AS bot_prs_merged",
    "q43c_partial_buckets": MODEL
    + "SELECT owner, 'week' AS period_kind, week_start AS period_start, count(*) AS commits, (week_start + 7 > DATE '1998-06-16')::BIGINT AS is_partial FROM cc WHERE day_start <= DATE '1998-06-15' GROUP BY ALL UNION ALL SELECT owner, 'month', month_start, count(*), ((month_start + INTERVAL 1 MONTH)::DATE > DATE '1998-06-16')::BIGINT FROM cc WHERE day_start <= DATE '1998-06-15' GROUP BY ALL",
    "q44_coverage_by_run": COVERAGE + "SELECT run_id, unit_kind, count(*) AS total, count(*) FILTER (method = 'script') AS n_script, count(*) FILTER (method = 'script-with-fallback') AS n_script_fallback, count(*) FILTER (method = 'llm') AS n_llm, round(100.0::DOUBLE * count(*) FILTER (method <> 'llm') / count(*), 4) AS coverage_pct, round(100.0::DOUBLE * count(*) FILTER (method = 'script') / count(*), 4) AS pure_script_pct FROM c GROUP BY ALL",
    "q45_backlog": COVERAGE + "SELECT unit_kind, coalesce(detail, '(no reason recorded)') AS reason, count(*) AS hits FROM c WHERE method = 'llm' GROUP BY ALL ORDER BY hits DESC, unit_kind, reason LIMIT 25",
    "q46_stream_daily_counts": DAILY,
    "q47_event_windows": "SELECT date_trunc('week', ts)::DATE AS week_start, event_type, count(*) AS events FROM events GROUP BY ALL",
    "q48_url_forms": "SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*$') THEN lower(url) || '/' ELSE regexp_replace(url, '#.*$', '') END AS url, len(regexp_extract_all(html, '<!--\\s*note\\b')) AS notes, 1::BIGINT AS safe FROM pages",
    "q49_receipts": "SELECT 1::BIGINT AS round_trip, CASE WHEN c_acctbal < 0 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS receipts, min(hex(c_name)) AS first_hex FROM customer GROUP BY ALL",
    "q50_scorecard": MODEL
    + """, f AS (SELECT *, date_trunc('week', created_at)::DATE AS week_start FROM pe WHERE is_shallow = 0), t AS (SELECT week_start, class, row_number() OVER (PARTITION BY week_start ORDER BY count(*) DESC, class) AS rk FROM f GROUP BY week_start, class), p AS (SELECT week_start, count(*) AS planned, count(*) FILTER (state = 'MERGED') AS merged, count(*) FILTER (class = 'revert') AS reverts FROM f GROUP BY 1)
SELECT week_start, planned, merged, reverts, class AS top_class, round(100.0::DOUBLE * merged / nullif(planned, 0), 4) AS merged_pct, round(100.0::DOUBLE * reverts / nullif(merged, 0), 4) AS rework_pct FROM p JOIN t USING (week_start) WHERE rk = 1""",
    "q51_regressions": "WITH u AS (SELECT user_id, bool_or(extract(day FROM ts) <= 15) AS b, bool_or(extract(day FROM ts) > 15) AS h FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, CASE WHEN b AND h THEN 'still' WHEN h THEN 'regression' ELSE 'fixed' END AS kind FROM u",
    "q52_secret_scan": "SELECT doc_id, 'cloud-key' AS kind FROM documents WHERE regexp_matches(text, 'AKIA[0-9A-Z]{16}') UNION ALL SELECT doc_id, 'token' FROM documents WHERE regexp_matches(text, 'token = \"[0-9a-f]{40}\"') UNION ALL SELECT doc_id, 'password' FROM documents WHERE regexp_matches(text, 'password=[0-9a-f]{8,}') UNION ALL SELECT doc_id, 'private-key' FROM documents WHERE contains(text, '-----BEGIN')",
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every activity query that SQL expresses."""
    again = {"q44b_ledger": "q44_coverage_by_run", "q80_first_occurrence_stream": "q11_adopters_cumulative", "q81_maintained_daily": "q25_incremental_equals_full", "q82_bucketed_upsert": "q23_upsert_latest"}
    return SQL | {k: SQL[v] for k, v in again.items()} | runbook.SQL | records.SQL | scale.SQL | {k: MODEL + v for k, v in records.MODELLED.items()}
