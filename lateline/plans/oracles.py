"""The same values in ANSI SQL, for engines with RE2 patterns and list lambdas."""

from lateline import fixed_values as fv
from lateline.operators.sentiment import LEXICON
from lateline.sources import star

# ---- small SQL helpers -----------------------------------------------------


def _r(x, k):
    """Round half up at k decimals."""
    return f"(floor(({x}) * 1e{k} + 0.5) / 1e{k})"


def _mean(x):
    """Mean by an exact sum."""
    return f"CAST(sum(CAST({x} AS DECIMAL(20, 10))) AS DOUBLE) / count({x})"


def _fixed(x, k):
    """Text with exactly k decimals."""
    units = f"CAST(floor(abs({x}) * 1e{k} + 0.5) AS BIGINT)"
    sign = f"CASE WHEN ({x}) < 0 AND {units} > 0 THEN '-' ELSE '' END"
    if k == 0:
        return f"({sign} || CAST({units} AS VARCHAR))"
    return f"({sign} || CAST({units} // {10**k} AS VARCHAR) || '.' || lpad(CAST({units} % {10**k} AS VARCHAR), {k}, '0'))"


def _percent(x, k=0):
    return f"({_fixed(_r(f'({x}) * 100', k), k)} || '%')"


def _iso(x):
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"


def _case(x, mapping, other="NULL"):
    return f"CASE {x} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in mapping.items()) + f" ELSE {other} END"


def _lit(v):
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _n(x):
    return f"CAST({x} AS BIGINT)"


_WS = fv.WHITE_SPACE
_AS_OF = "TIMESTAMP '2001-12-01 00:00:00'"
_TYPES = dict(enumerate(star.ISSUE_TYPES[:-1]))
_SEGMENTS = dict(enumerate(star.SEGMENTS))

# ---- tickets, features, label ----------------------------------------------

HEADS = f"""
heads AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS issue_id,
    c_mktsegment || '-' || o_orderkey AS issue_key, c_mktsegment AS project_key,
    'Order ' || o_orderkey || ' ' || o_orderpriority AS summary,
    {_case('o_orderstatus', star.STATUS)} AS status,
    {_case('o_orderpriority', star.PRIORITY)} AS priority,
    {_case('o_orderkey % 7', _TYPES, "'Other'")} AS issue_type,
    CASE WHEN o_custkey % 17 <> 0 THEN 'engineer_' || (o_custkey % 50) END AS assignee,
    o_orderdate AS created,
    greatest(o_orderdate, {_AS_OF} - to_days(CAST(((o_orderkey * 13 + o_custkey * 7) % 30)
      * CASE WHEN o_orderkey % 10 = 0 THEN 5 ELSE 1 END AS INTEGER))) AS updated,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + to_days(60) END AS due_date,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey * 37 % 120 AS INTEGER)) END AS resolution_date,
    (o_orderkey * 7919 % 10000) / 1e4 AS rule_score
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

TICKETS = (
    HEADS
    + f""",
measures AS (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS points, {_n('sum(l_linenumber)')} AS comments,
    count(*) FILTER (WHERE l_discount >= 0.08) AS sprints,
    'Sprint ' || max(CASE WHEN l_discount >= 0.08 THEN l_linenumber END) AS current_sprint_name,
    count(*) FILTER (WHERE l_discount <= 0.02) AS links,
    count(*) FILTER (WHERE l_discount <= 0.02 AND l_returnflag = 'R') AS blockers
  FROM lineitem GROUP BY l_orderkey),
words AS (SELECT doc_id, text, CAST(len(regexp_extract_all(text, '[^{_WS}]+')) AS BIGINT) AS words FROM documents),
tickets AS (
  SELECT h.*, m.points, coalesce(m.comments, 0) AS comment_count, coalesce(m.sprints, 0) AS sprints,
    m.current_sprint_name, coalesce(m.links, 0) AS links, coalesce(m.blockers, 0) AS blockers, w.words, w.text AS description
  FROM heads h LEFT JOIN measures m ON m.l_orderkey = h.k
  LEFT JOIN words w ON w.doc_id = h.k % (SELECT count(*) FROM documents))"""
)


def _age(x):
    days = f"(epoch_us({_AS_OF}) - epoch_us({x})) / 8.64e10"
    return _r(f"greatest(coalesce({days}, 0.0), 0.0)", 1)


FEATURES = (
    TICKETS
    + f""",
features AS (
  SELECT t.*, status AS status_category, coalesce(points, 0.0) AS story_points,
    CAST(links > 0 AS INTEGER) AS has_dependency, links AS dependency_count,
    {_case('priority', fv.PRIORITY_RANK, 3)} AS priority_numeric,
    {_case('priority', fv.PRIORITY_RANK, 3)} * coalesce(points, 0.0) AS priority_interaction,
    {_age('updated')} AS days_in_status, {_age('created')} AS days_since_created,
    CAST(coalesce({_AS_OF} > due_date, false) AS INTEGER) AS is_overdue,
    CASE WHEN words < 10 THEN 1e0 WHEN words > 500 THEN 0.5e0 ELSE 0e0 END AS description_ambiguity,
    words AS description_word_count,
    greatest(sprints - 1, 0) AS sprint_rollover_count,
    greatest(sprints - 1, 0) + comment_count // 5 AS ticket_churn,
    CAST(sprints > 1 AS INTEGER) + CAST(comment_count > 10 AS INTEGER) AS assignee_churn,
    CASE WHEN links = 0 THEN 0e0 ELSE {_r('blockers / links', 2)} END AS blocker_dependency_ratio,
    CAST({_case('issue_type', fv.ISSUE_TYPE_RISK, fv.ISSUE_TYPE_RISK_OTHER)} AS DOUBLE) AS issue_type_risk,
    {_case('status', fv.STATUS_CATEGORY_CODE, 0)} AS status_category_encoded
  FROM tickets t)"""
)

TEAM = (
    FEATURES
    + f""",
projects AS (
  SELECT project_key, {_r('sum(story_points) / greatest(count(DISTINCT assignee), 1)', 2)} AS complexity_per_person,
    count(*) FILTER (WHERE status = 'In Progress') AS team_wip
  FROM features GROUP BY project_key),
loads AS (SELECT assignee, sum(story_points) AS assignee_load FROM features WHERE assignee IS NOT NULL GROUP BY assignee),
team AS (
  SELECT f.*, p.complexity_per_person, p.team_wip, coalesce(l.assignee_load, 0.0) AS assignee_load
  FROM features f JOIN projects p USING (project_key) LEFT JOIN loads l ON l.assignee = f.assignee)"""
)


def _label(source, by_project=False):
    medians = "SELECT project_key, quantile_cont(days_in_status, 0.5) AS median_days FROM {0} WHERE status = 'In Progress' GROUP BY 1"
    if not by_project:
        medians = "SELECT p.project_key, m.median_days FROM (SELECT DISTINCT project_key FROM {0}) p, (SELECT quantile_cont(days_in_status, 0.5) AS median_days FROM {0} WHERE status = 'In Progress') m"
    return f""",
medians AS ({medians.format(source)}),
labelled AS (
  SELECT s.*, CAST(coalesce(resolution_date > due_date, false) OR sprint_rollover_count > 0
    OR coalesce(status = 'In Progress' AND median_days > 0 AND days_in_status > median_days * 2, false) AS INTEGER) AS is_delayed
  FROM {source} s LEFT JOIN medians USING (project_key))"""


# ---- messages and series ---------------------------------------------------

MESSAGES = f"""
messages AS (
  SELECT event_id, {_case('user_id % 5', _SEGMENTS)} AS project_key, 'C' || (user_id % 5) AS channel_id,
    'U' || user_id AS user_id, {_case('event_type', star.EVENT_TEXT)} AS text, ts,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS reaction_count,
    greatest(-1.0, least(1.0, (50 - value) / 100)) AS sentiment_score
  FROM events)"""


def _series(unit="day", keys="project_key,", source="messages", name="series", where="true"):
    return f""",
{name} AS (
  SELECT {keys} {_iso(f"date_trunc('{unit}', ts)")} AS window_start, {_r(_mean('sentiment_score'), 4)} AS avg_sentiment,
    count(*) AS message_count, {_r('coalesce(stddev_samp(sentiment_score), 0)', 4)} AS std_dev
  FROM {source} GROUP BY {keys} date_trunc('{unit}', ts) HAVING {where})"""


def _anomalies(keys="PARTITION BY project_key", source="series"):
    z = f"(avg_sentiment - avg(avg_sentiment) OVER ({keys})) / nullif(stddev_samp(avg_sentiment) OVER ({keys}), 0)"
    return f""",
zs AS (SELECT *, {z} AS z, count(*) OVER ({keys}) AS windows FROM {source}),
anomalies AS (
  SELECT * EXCLUDE (z, windows), {_r('z', 4)} AS z_score, '{fv.ANOMALY_TYPE}' AS anomaly_type
  FROM zs WHERE windows >= 3 AND z < -2)"""


FIRST = """,
first_anomalies AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_key ORDER BY window_start) AS INTEGER) AS anomaly_rank FROM anomalies)
  WHERE anomaly_rank <= 5)"""

MOOD = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY window_start DESC) AS rn FROM series),
mood AS (
  SELECT project_key, avg_sentiment, avg_sentiment - previous AS raw_velocity FROM (
    SELECT project_key, max(CASE WHEN rn = 1 THEN avg_sentiment END) AS avg_sentiment,
      coalesce(max(CASE WHEN rn = 2 THEN avg_sentiment END), max(CASE WHEN rn = 1 THEN avg_sentiment END)) AS previous
    FROM ranked WHERE rn <= 2 GROUP BY 1)),
velocity AS (
  SELECT project_key, avg_sentiment, floor(raw_velocity * 1e4 + 0.5) / 1e4 AS sentiment_velocity,
    CAST(raw_velocity < -0.3 AS INTEGER) AS sentiment_anomaly FROM mood),
outlook AS (
  SELECT project_key, avg(avg_sentiment) AS mean, count(*) AS recent_windows FROM ranked WHERE rn <= 7 GROUP BY 1)"""


def _scores(source, text, keys, singles=None, pairs=None):
    """Scores with the rules: each term, its case, the three words before it, "but", emphasis.

    A term within a pair does not count beside it. `singles` and `pairs` are
    SELECTs of term and valence in place of the built-in lexicon.
    """
    singles = singles or "VALUES " + ", ".join(f"({_lit(t)}, {v}e0)" for t, v in LEXICON.items() if " " not in t)
    pairs = pairs or "VALUES " + ", ".join(f"({_lit(t)}, {v}e0)" for t, v in LEXICON.items() if " " in t)

    def one_of(words):
        return "(" + ", ".join(map(_lit, words)) + ")"

    steps, value = "", "v0"
    for d, fades in enumerate(fv.BOOST_BY_DISTANCE, 1):
        before = f"(CASE WHEN i > {d} THEN lowered[i - {d}] END)"
        strength = f"CASE WHEN {before} IN {one_of(fv.BOOSTERS)} THEN 0.293e0 WHEN {before} IN {one_of(fv.DAMPENERS)} THEN -0.293e0 ELSE 0e0 END"
        turned = f"CASE WHEN {before} IN {one_of(fv.NEGATIONS)} THEN -0.74e0 ELSE 1e0 END"
        skip = f"{before} IS NULL OR {before} IN (SELECT term FROM singles)"
        steps += f""",
step{d} AS (SELECT *, CASE WHEN {skip} THEN {value} ELSE ({value} + sign({value}) * ({strength}) * {fades}e0) * ({turned}) END AS v{d} FROM step{d - 1})"""
        value = f"v{d}"
    key_list = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f""",
singles(term, valence) AS ({singles}),
pairs(term, valence) AS ({pairs}),
split AS (SELECT {keys}, {text} AS body, string_split_regex({text}, '[^\\pL\\pN_\'\']+') AS words FROM {source}),
both_cases AS (SELECT *, list_transform(words, lambda w: lower(w)) AS lowered FROM split),
placed AS (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM both_cases),
paired AS (
  SELECT {key_list}, i, valence FROM placed s JOIN pairs ON i < len(words) AND lowered[i] || ' ' || lowered[i + 1] = term),
alone AS (SELECT * FROM placed ANTI JOIN (SELECT {keys}, i FROM paired UNION SELECT {keys}, i + 1 FROM paired) USING ({keys}, i)),
step0 AS (
  SELECT s.*, valence + CASE WHEN upper(words[i]) = words[i] AND len(list_filter(words, lambda w: upper(w) <> w)) > 0
    THEN sign(valence) * 0.733e0 ELSE 0e0 END AS v0
  FROM alone s JOIN singles ON lowered[i] = term){steps},
valences AS (
  SELECT {keys}, v3 * CASE WHEN coalesce(list_position(lowered, 'but'), 0) = 0 OR list_position(lowered, 'but') = i THEN 1e0
    WHEN i < list_position(lowered, 'but') THEN 0.5e0 ELSE 1.5e0 END AS v FROM step3
  UNION ALL
  SELECT {keys}, valence AS v FROM paired),
totals AS (SELECT {keys}, sum(v) AS total FROM valences GROUP BY {keys}),
emphasis AS (
  SELECT {keys}, least(len(regexp_extract_all(body, '!')), 4) * 0.292e0 + CASE WHEN len(regexp_extract_all(body, '\\?')) <= 1 THEN 0e0
    WHEN len(regexp_extract_all(body, '\\?')) <= 3 THEN len(regexp_extract_all(body, '\\?')) * 0.18e0 ELSE 0.96e0 END AS e FROM split),
loud AS (SELECT *, total + sign(total) * e AS l FROM totals JOIN emphasis USING ({keys})),
scores AS (SELECT {keys}, {_r('CASE WHEN total = 0 THEN 0 ELSE l / sqrt(l * l + 15) END', 4)} AS score FROM loud)"""


def _levels(source="heads", score="rule_score"):
    return f""",
scored AS (
  SELECT *, {_r(score, 4)} AS risk_score,
    CASE WHEN {_r(score, 4)} >= 0.7 THEN 'High' WHEN {_r(score, 4)} >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM {source})"""


LEVEL_COUNTS = """count(*) FILTER (WHERE risk_level = 'High') AS high_risk,
  count(*) FILTER (WHERE risk_level = 'Medium') AS medium_risk, count(*) FILTER (WHERE risk_level = 'Low') AS low_risk"""

# ---- redaction -------------------------------------------------------------

_SECRETS = [
    (r"(^|[^A-Z0-9])AKIA[0-9A-Z]{16}($|[^A-Z0-9])", r"\1[AWS_ACCESS_KEY]\2"),
    (
        rf"(?i)(^|[^\pL\pN_])(?:api[_-]?key|token|secret|password)[{_WS}]*[:=][{_WS}]*['\"]?[A-Za-z0-9_\-]{{20,}}['\"]?",
        r"\1[REDACTED_SECRET]",
    ),
    (rf"(?i)(?:postgres|mysql|mongodb|redis)://[^{_WS}]+", "[DATABASE_URI]"),
    (r"(?s)-----BEGIN (?:RSA |EC )?PRIVATE KEY-----.*?-----END (?:RSA |EC )?PRIVATE KEY-----", "[PRIVATE_KEY]"),
]


def _redact(text):
    for pattern, replacement in _SECRETS:
        text = f"regexp_replace({text}, {_lit(pattern)}, {_lit(replacement)}, 'g')"
    return text


def _count_secrets(text):
    return " + ".join(f"len(regexp_extract_all({text}, {_lit(p)}))" for p, _ in _SECRETS)


def _re2(pattern):
    pattern = pattern.replace("(?<![0-9A-Za-z_])", r"\b").replace("(?![0-9A-Za-z_])", r"\b")
    return pattern.replace("(?<![A-Za-z0-9._%+-])", "").replace("}+@", "}@")


_ENTITIES = [(name, _re2(pattern)) for name, pattern in fv.ENTITY_PATTERNS]
_ANY = _lit("|".join(f"(?:{p})" for _, p in _ENTITIES))


def _type_of(hit):
    cases = " ".join(f"WHEN regexp_full_match({hit}, {_lit(p)}) THEN '{name}'" for name, p in _ENTITIES)
    return f"CASE {cases} ELSE 'PHONE' END"


def _mark_of(hit):
    cases = " ".join(f"WHEN regexp_full_match({hit}, {_lit(p)}) THEN '{fv.ENTITY_PLACEHOLDERS[name]}'" for name, p in _ENTITIES)
    return f"CASE {cases} ELSE '[PHONE]' END"


def _pieces(source, key, text, carry=""):
    return f"""
clean AS (SELECT {key} {carry}, {text} AS t FROM {source}),
pieces AS (SELECT *, regexp_extract_all(t, {_ANY}) AS hits, string_split_regex(t, {_ANY}) AS gaps FROM clean)"""


_FILLED = f"""array_to_string(list_transform(range(1, len(gaps) + 1), lambda i:
  gaps[i] || CASE WHEN i <= len(hits) THEN {_mark_of('hits[i]')} ELSE '' END), '')"""

# ---- quality ---------------------------------------------------------------


def _quality(by_project):
    key = "project_key, " if by_project else ""
    group = "GROUP BY project_key" if by_project else ""
    over = "project_key, " if by_project else ""

    def violation(column, rule, expected, actual, message, broken, invalid="NULL", source="profile"):
        return f"""SELECT {key}'{column}' AS "column", '{rule}' AS rule, CAST({expected} AS DOUBLE) AS expected,
  CAST({actual} AS DOUBLE) AS actual, {message} AS message, CAST({invalid} AS VARCHAR) AS invalid_values FROM {source} WHERE {broken}"""

    def complete(column, least):
        share = f"{column}_n / n"
        text = f"'Completeness ' || {_percent(share, 1)} || ' < {least * 100:.1f}%'"
        return violation(column, "completeness", least, _r(share, 4), text, f"{share} < {least}")

    parts = [
        complete("story_points", 0.5),
        violation("story_points", "min_value", 0, "sp_min", "'Min value ' || sp_min || ' < 0'", "sp_min < 0"),
        violation("story_points", "max_value", 100, "sp_max", "'Max value ' || sp_max || ' > 100'", "sp_max > 100"),
        complete("issue_key", 1.0),
        violation("issue_key", "uniqueness", 1, _r("ik_d / greatest(issue_key_n, 1)", 4),
                  f"'Uniqueness ' || {_percent('ik_d / greatest(issue_key_n, 1)', 1)} || ' < 100.0%'", "ik_d < issue_key_n"),
        complete("status", 0.95),
        complete("priority", 0.8),
        complete("created", 1.0),
        complete("issue_type", 1.0),
        complete("resolution_date", 0.5),
        violation("sprint", "column_exists", "NULL", "NULL", "'Required column ''sprint'' not found'", "true"),
        violation("issue_type", "allowed_values", "NULL", "NULL", "'Found ' || c || ' invalid categorical values'", "c > 0", "vals", "offenders"),
    ]
    allowed = "('Bug', 'Story', 'Task', 'Epic')"
    return (
        "WITH "
        + TICKETS
        + f""",
profile AS (
  SELECT {key} count(*) AS n, count(points) AS story_points_n, avg(points) AS sp_mean, stddev_samp(points) AS sp_std,
    min(points) AS sp_min, max(points) AS sp_max, count(issue_key) AS issue_key_n, count(DISTINCT issue_key) AS ik_d,
    count(status) AS status_n, count(priority) AS priority_n, count(created) AS created_n,
    count(issue_type) AS issue_type_n, count(resolution_date) AS resolution_date_n
  FROM tickets {group}),
offenders AS (
  SELECT {key} count(*) AS c, string_agg(issue_type, ',' ORDER BY issue_type) AS vals
  FROM (SELECT DISTINCT {key} issue_type FROM tickets WHERE issue_type NOT IN {allowed}) {group}),
violations AS ({' UNION ALL '.join(parts)}),
broken AS (SELECT {over} count(*) AS violations_count FROM violations {group}),
summary AS (
  SELECT {('p.' + key) if by_project else ''} coalesce(b.violations_count, 0) = 0 AS passed, 21 AS total_checks,
    coalesce(b.violations_count, 0) AS violations_count, p.n AS row_count, 8 AS column_count
  FROM profile p LEFT JOIN broken b {'USING (project_key)' if by_project else 'ON true'})"""
    )


_METRICS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{m}' AS metric, CAST({_r(x, 4)} AS DOUBLE) AS value FROM profile"""
    for c, m, x in [
        ("story_points", "completeness", "story_points_n / n"),
        ("story_points", "mean", "sp_mean"),
        ("story_points", "std", "sp_std"),
        ("story_points", "min", "sp_min"),
        ("story_points", "max", "sp_max"),
        ("issue_key", "completeness", "issue_key_n / n"),
        ("issue_key", "uniqueness", "ik_d / greatest(issue_key_n, 1)"),
        ("status", "completeness", "status_n / n"),
        ("priority", "completeness", "priority_n / n"),
        ("created", "completeness", "created_n / n"),
        ("issue_type", "completeness", "issue_type_n / n"),
        ("resolution_date", "completeness", "resolution_date_n / n"),
    ]
)

# ---- drift -----------------------------------------------------------------

_DRIFT_FEATURES = list(fv.MODEL_FEATURES)
PROFILES = (
    TEAM
    + ", "
    + MESSAGES
    + _series()
    + MOOD
    + f""",
rich AS (
  SELECT t.*, coalesce(v.avg_sentiment, 0.0) AS avg_sentiment, coalesce(v.sentiment_velocity, 0.0) AS sentiment_velocity,
    coalesce(v.sentiment_anomaly, 0) AS sentiment_anomaly FROM team t LEFT JOIN velocity v USING (project_key)),
typed AS (
  SELECT CASE WHEN created < TIMESTAMP '1999-01-01' THEN 'baseline' ELSE 'current' END AS period,
    {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _DRIFT_FEATURES)} FROM rich),
long AS (UNPIVOT typed ON {', '.join(_DRIFT_FEATURES)} INTO NAME feature VALUE value),
profiles AS (
  SELECT period, feature, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, min(value) AS min, max(value) AS max, count(*) AS count
  FROM long GROUP BY 1, 2),
base AS (
  SELECT * EXCLUDE (period) FROM profiles WHERE period = 'baseline'
  UNION ALL SELECT * REPLACE ('retired_feature' AS feature) FROM (SELECT * EXCLUDE (period) FROM profiles WHERE period = 'baseline' AND feature = 'story_points')),
shifts AS (
  SELECT b.feature, c.feature IS NULL AS missing, b.mean AS baseline_mean, c.mean AS current_mean,
    abs(c.mean - b.mean) / CASE WHEN b.std = 0 THEN 1 ELSE b.std END AS mean_shift,
    abs(c.median - b.median) / CASE WHEN b.std = 0 THEN 1 ELSE b.std END AS median_shift,
    abs((c.p75 - c.p25) - (b.p75 - b.p25)) / greatest(b.p75 - b.p25, 0.01) * 100 AS iqr_change
  FROM base b LEFT JOIN (SELECT * FROM profiles WHERE period = 'current') c USING (feature)),
report AS (
  SELECT feature, CASE WHEN missing THEN 'missing' WHEN mean_shift > 0.3 OR iqr_change > 20 THEN 'drifted' ELSE 'stable' END AS status,
    {_r('mean_shift', 4)} AS mean_shift_std, {_r('median_shift', 4)} AS median_shift_std, {_r('iqr_change', 2)} AS iqr_change_pct,
    {_r('baseline_mean', 6)} AS baseline_mean, {_r('current_mean', 6)} AS current_mean
  FROM shifts)"""
)

# ---- folds -----------------------------------------------------------------

FOLDED = (
    FEATURES
    + _label("features")
    + """,
numbered AS (
  SELECT issue_key, created, rule_score, is_delayed,
    row_number() OVER (ORDER BY created, issue_key) - 1 AS ordinal, count(*) OVER () AS n FROM labelled),
folded AS (
  SELECT *, CASE WHEN ordinal >= n - 5 * (n // 6) THEN CAST((ordinal - (n - 5 * (n // 6))) // (n // 6) AS INTEGER) END AS test_fold
  FROM numbered)"""
)

_TICKET_LINE = f"""'- [' || issue_key || '] ' || summary || ' | Status: ' || status || ' | Risk: ' || {_percent('risk_score')}
  || ' | Points: ' || CAST(story_points AS VARCHAR) || ' | Days in Status: ' || {_fixed('days_in_status', 0)}
  || ' | Dependencies: ' || CAST(dependency_count AS VARCHAR)"""

DIGEST = f""",
top AS (
  SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY risk_score DESC, issue_key) AS rn
  FROM scored WHERE risk_level = 'High'),
lines AS (SELECT project_key, string_agg({_TICKET_LINE}, chr(10) ORDER BY rn) AS lines FROM top WHERE rn <= 15 GROUP BY 1),
high_digest AS (
  SELECT p.project_key, coalesce(lines, '{fv.NO_HIGH_RISK_TEXT}') AS high_risk_digest
  FROM (SELECT DISTINCT project_key FROM scored) p LEFT JOIN lines USING (project_key))"""

SCORE_DIGEST = f""",
score_digest AS (
  SELECT project_key, 'Risk Distribution: ' || count(*) FILTER (WHERE risk_level = 'High') || ' High, '
    || count(*) FILTER (WHERE risk_level = 'Medium') || ' Medium, ' || count(*) FILTER (WHERE risk_level = 'Low') || ' Low' || chr(10)
    || 'Average Risk Score: ' || {_percent(_mean('risk_score'), 2)} || chr(10) || 'Total Tickets Scored: ' || count(*) AS score_digest
  FROM scored GROUP BY project_key)"""

SENTIMENT_DIGEST = f""",
anomaly_counts AS (SELECT project_key, count(*) AS c FROM anomalies GROUP BY 1),
anomaly_lines AS (
  SELECT project_key, string_agg('- ' || window_start || ': sentiment=' || {_fixed('avg_sentiment', 3)} || ', z-score=' || {_fixed('z_score', 2)},
    chr(10) ORDER BY anomaly_rank) AS lines FROM first_anomalies GROUP BY 1),
sentiment_digest AS (
  SELECT o.project_key, 'Overall team sentiment is ' || CASE WHEN mean > 0.1 THEN 'positive' WHEN mean < -0.1 THEN 'negative' ELSE 'neutral' END
    || ' (avg: ' || {_fixed('mean', 3)} || ').' || coalesce(chr(10) || chr(10) || c || ' sentiment anomalies detected:' || chr(10) || lines, '') AS sentiment_digest
  FROM outlook o LEFT JOIN anomaly_counts USING (project_key) LEFT JOIN anomaly_lines USING (project_key))"""

FACTS = f""",
facts AS (
  SELECT project_key, count(*) AS total_tickets, count(*) FILTER (WHERE status = 'Done') AS completed,
    count(*) FILTER (WHERE status = 'In Progress') AS in_progress, {LEVEL_COUNTS} FROM scored GROUP BY project_key)"""

WITH_MOOD = """,
rated AS (
  SELECT f.*, coalesce(v.avg_sentiment, 0.0) AS avg_sentiment FROM features f LEFT JOIN velocity v USING (project_key))"""

RADAR = f""",
points AS (
  SELECT project_key, issue_key, substr(summary, 1, 80) AS summary, {_r('story_points * issue_type_risk', 4)} AS x,
    {_r('avg_sentiment', 4)} AS y, greatest(story_points, 1.0) AS size,
    greatest(4.0, least(greatest(story_points, 1.0) * 3, 30.0)) AS radius, risk_level AS color, risk_score, status, assignee, days_in_status
  FROM scored)"""

_FACTOR_ROWS = "(1, 'sprint_rollover_count', 0.5e0), (2, 'days_in_status', 0.25e0), (3, 'story_points', 0.125e0), (4, 'is_overdue', 0.0625e0)"
FACTORS = f""",
importance(rank, feature, importance) AS (VALUES {_FACTOR_ROWS}),
factors AS (
  SELECT s.issue_key, s.project_key, CAST(i.rank AS INTEGER) AS rank, i.feature,
    CAST(CASE i.feature WHEN 'sprint_rollover_count' THEN sprint_rollover_count WHEN 'days_in_status' THEN days_in_status
      WHEN 'story_points' THEN story_points ELSE is_overdue END AS DOUBLE) AS value, i.importance
  FROM {{0}} s CROSS JOIN importance i)"""

# ---- flattening ------------------------------------------------------------

_BASE = "orders JOIN customer ON o_custkey = c_custkey"
_DESCRIPTION = "'Ask buyer' || o_custkey || '@example.com about host 10.0.' || (o_orderkey % 250) || '.7 and order ' || o_orderkey"
_CREATED = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000+0000')"
_SPRINT_OBJECT = "o_orderkey || '|Sprint ' || o_orderkey || '|closed|' || strftime(o_orderdate, '%Y-%m-%d') || '|-|-'"
_SPRINT_TEXT = "o_orderkey || '|Late ' || o_orderkey || '|ACTIVE|-|-|-'"
_REPLY = """'{"hypothesis":"load ' || event_id || '"'"""
_STREAM_CLOSED = "date_trunc('day', ts) + to_days(1) <= (SELECT max(ts) - to_hours(2) FROM messages)"


def oracle_sql():
    """name -> SQL; of the fitted model, what must hold of its results."""
    from lateline.operators.reports import REPORT_KEYS
    from lateline.plans.queries import CHUNK_BYTES, PERIOD

    sql = {}
    sql["ticket_features"] = f"""WITH {FEATURES}
SELECT issue_key, {', '.join(fv.MODEL_FEATURES[:16])}, comment_count, current_sprint_name FROM features"""
    sql["team_features"] = f"WITH {TEAM} SELECT issue_key, complexity_per_person, team_wip, assignee_load FROM team"
    sql["merged_sentiment"] = f"""WITH {HEADS}, {MESSAGES} {_series()} {MOOD}
SELECT issue_key, coalesce(avg_sentiment, 0.0) AS avg_sentiment, coalesce(sentiment_velocity, 0.0) AS sentiment_velocity,
  coalesce(sentiment_anomaly, 0) AS sentiment_anomaly FROM heads LEFT JOIN velocity USING (project_key)"""
    sql["delay_label"] = f"WITH {FEATURES} {_label('features')} SELECT issue_key, project_key, is_delayed FROM labelled"
    sql["delay_label_by_project"] = f"WITH {FEATURES} {_label('features', True)} SELECT issue_key, project_key, is_delayed FROM labelled"
    sql["project_delay_summary"] = f"""WITH {TEAM} {_label('team')}
SELECT project_key, count(*) AS tickets, {_n('sum(is_delayed)')} AS delayed, {_n('sum(links)')} AS links,
  count(DISTINCT assignee) AS assignees, sum(story_points) AS points, max(team_wip) AS wip,
  max(complexity_per_person) AS complexity_per_person FROM labelled GROUP BY project_key"""
    inputs = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in fv.MODEL_FEATURES)
    sql["model_input"] = f"""WITH {TEAM}, {MESSAGES} {_series()} {MOOD}
SELECT issue_key, {inputs} FROM team LEFT JOIN velocity USING (project_key)"""

    sql["sentiment_score"] = f"""WITH {MESSAGES} {_scores('messages', 'text', 'event_id')}
SELECT event_id, channel_id, user_id, text, coalesce(score, 0.0) AS sentiment_score, CAST(0 AS BIGINT) AS reply_count,
  reaction_count, {_iso('ts')} AS datetime_utc FROM messages LEFT JOIN scores USING (event_id)"""
    sql["conversation_sentiment"] = f"""WITH src AS (SELECT * FROM conversations) {_scores('src', 'text', 'conv_id, turn')}
SELECT conv_id, turn, role, coalesce(score, 0.0) AS sentiment_score FROM src LEFT JOIN scores USING (conv_id, turn)"""
    words = "SELECT list_transform(string_split_regex(text, '[^\\pL\\pN_'']+'), lambda w: lower(w)) AS w FROM conversations"
    most = "SELECT term, length(term) % 5 - 2.5e0 FROM (SELECT {} AS term FROM (" + words + ")) {} GROUP BY term ORDER BY count(*) DESC, term LIMIT {}"
    singles = most.format("unnest(w)", "WHERE term <> ''", 10_000)
    neighbours = "unnest(list_transform(range(1, len(w)), lambda i: CASE WHEN w[i] <> '' AND w[i + 1] <> '' THEN w[i] || ' ' || w[i + 1] END))"
    pairs = most.format(neighbours, "WHERE term IS NOT NULL", 1_000)
    sql["file_lexicon_sentiment"] = f"""WITH src AS (SELECT * FROM conversations) {_scores('src', 'text', 'conv_id, turn', singles, pairs)}
SELECT conv_id, turn, role, coalesce(score, 0.0) AS sentiment_score FROM src LEFT JOIN scores USING (conv_id, turn)"""
    sql["sentiment_timeseries_day"] = f"WITH {MESSAGES} {_series()} SELECT * FROM series"
    sql["sentiment_timeseries_hour"] = f"WITH {MESSAGES} {_series('hour')} SELECT * FROM series"
    sql["sentiment_anomalies"] = f"WITH {MESSAGES} {_series()} {_anomalies()} {FIRST} SELECT * FROM first_anomalies"
    sql["sentiment_anomalies_all"] = f"WITH {MESSAGES} {_series('hour')} {_anomalies()} SELECT * FROM anomalies"
    sql["sentiment_anomalies_hourly"] = f"WITH {MESSAGES} {_series('hour', '')} {_anomalies('')} SELECT * FROM anomalies"
    sql["sentiment_outlook"] = f"""WITH {MESSAGES} {_series()} {MOOD}
SELECT project_key, {_r('mean', 6)} AS recent_sentiment, recent_windows,
  CASE WHEN mean > 0.1 THEN 'positive' WHEN mean < -0.1 THEN 'negative' ELSE 'neutral' END AS outlook FROM outlook"""
    sql["sentiment_velocity"] = f"WITH {MESSAGES} {_series()} {MOOD} SELECT * FROM velocity"

    sql["walk_forward_folds"] = f"WITH {FOLDED} SELECT issue_key, ordinal, test_fold FROM folded"
    sql["fold_weights"] = f"""WITH {FOLDED}
SELECT CAST(f.i AS INTEGER) AS fold, {_n('sum(is_delayed)')} AS positives, {_n('sum(1 - is_delayed)')} AS negatives,
  CASE WHEN sum(is_delayed) > 0 THEN sum(1 - is_delayed) / sum(is_delayed) ELSE 2.0 END AS positive_weight
FROM range(5) f(i) JOIN folded ON coalesce(test_fold, -1) < f.i GROUP BY f.i"""
    sql["classification_metrics"] = f"""WITH {FOLDED},
ranks AS (
  SELECT *, rank() OVER (PARTITION BY test_fold ORDER BY rule_score) + (count(*) OVER (PARTITION BY test_fold, rule_score) - 1) / 2 AS r
  FROM folded WHERE test_fold IS NOT NULL),
sums AS (
  SELECT test_fold, count(*) FILTER (WHERE rule_score > 0.5 AND is_delayed = 1) AS tp, count(*) FILTER (WHERE rule_score > 0.5 AND is_delayed = 0) AS fp,
    count(*) FILTER (WHERE rule_score <= 0.5 AND is_delayed = 1) AS fn, count(*) AS test_size, avg(is_delayed) AS positive_rate,
    sum(r) FILTER (WHERE is_delayed = 1) AS rank_sum, sum(is_delayed) AS p, sum(1 - is_delayed) AS n FROM ranks GROUP BY 1)
SELECT test_fold, {_r('CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END', 6)} AS recall,
  {_r('CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END', 6)} AS precision,
  {_r('CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END', 6)} AS f1, test_size,
  {_r('positive_rate', 6)} AS positive_rate,
  {_r('CASE WHEN p = 0 OR n = 0 THEN 0 ELSE (rank_sum - p * (p + 1) / 2) / (p * n) END', 6)} AS auc_roc FROM sums"""
    sql["risk_levels"] = f"WITH {HEADS} {_levels()} SELECT issue_key, risk_score, risk_level FROM scored"
    sql["ranked_factors"] = f"""WITH {FEATURES} {FACTORS.format('features')}
SELECT issue_key, rank, feature, value, importance FROM factors"""
    sql["risk_model_scores"] = f"""WITH {FEATURES} {_label('features')}
SELECT issue_key, project_key, is_delayed, true AS in_range, true AS level_fits FROM labelled"""
    sql["model_learns"] = f"WITH {HEADS} SELECT count(*) AS tickets, true AS tells_apart, true AS differs FROM heads"
    sql["feature_importance"] = 'SELECT CAST(0 AS BIGINT) AS unknown, CAST(0 AS BIGINT) AS negative, true AS adds_up, true AS "distinct"'
    sql["top_risk_factors"] = f"WITH {HEADS} SELECT issue_key, CAST({fv.TOP_FACTORS} AS BIGINT) AS factors, true AS own_values FROM heads"
    sql["model_storage"] = f"WITH {HEADS} SELECT project_key, count(*) AS tickets, CAST(0 AS BIGINT) AS changed FROM heads GROUP BY 1"

    sql["quality_metrics"] = f"{_quality(False)} {_METRICS}"
    sql["quality_violations"] = f"{_quality(False)} SELECT * FROM violations"
    sql["quality_summary"] = f"{_quality(False)} SELECT * FROM summary"
    sql["quality_by_project"] = f"{_quality(True)} SELECT * FROM summary"
    sql["quality_violations_by_project"] = f"{_quality(True)} SELECT * FROM violations"
    sql["quality_alerts"] = f"""{_quality(True)}
SELECT '{fv.QUALITY_ALERT}' AS alert_type, project_key, count(*) AS violations, min("column") AS first_column,
  '{star.AS_OF}' AS created_at FROM violations GROUP BY project_key"""
    six = ", ".join(f"{_r(c, 6)} AS {c}" for c in ("mean", "std", "median", "p25", "p75"))
    sql["drift_profile"] = f"WITH {PROFILES} SELECT period, feature, {six}, min, max, count FROM profiles"
    sql["drift_report"] = f"WITH {PROFILES} SELECT * FROM report"
    sql["drift_summary"] = f"""WITH {PROFILES},
c AS (SELECT count(*) AS total_features, count(*) FILTER (WHERE status <> 'stable') AS drifted_count,
  coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE status <> 'stable'), '') AS drifted_features FROM report)
SELECT {_r('drifted_count / total_features * 100', 2)} AS overall_drift_pct, drifted_count / total_features * 100 > 10 AS needs_retrain,
  drifted_features, total_features, drifted_count FROM c"""
    sql["baseline_roundtrip"] = f"WITH {PROFILES} SELECT feature, {six}, min, max, count FROM profiles WHERE period = 'current'"
    one = PROFILES.replace("CASE WHEN created < TIMESTAMP '1999-01-01' THEN 'baseline' ELSE 'current' END AS period", "unnest(CASE WHEN project_key = 'BUILDING' THEN ['baseline', 'current'] ELSE ['baseline'] END) AS period")
    sql["drift_status"] = f"WITH {one} SELECT * FROM report WHERE feature <> 'retired_feature'"
    sql["retrain_requests"] = """SELECT event_id, value AS overall_drift_pct, project_key
FROM events CROSS JOIN (VALUES ('PROJ'), ('ALPHA')) p(project_key) WHERE event_type = 'error'"""

    sql["open_retrain_requests"] = sql["retrain_requests"] + " AND event_id % 3 <> 0"
    sql["drift_alert"] = f"""WITH {PROFILES},
c AS (SELECT {_r("count(*) FILTER (WHERE status <> 'stable') / count(*) * 100", 2)} AS share, min(feature) FILTER (WHERE status <> 'stable') AS f FROM report)
SELECT '{fv.DRIFT_ALERT}' AS alert_type, CAST(share AS DOUBLE) AS overall_drift_pct, f AS first_feature, '{star.AS_OF}' AS created_at FROM c WHERE share > 10"""

    sql["secret_redaction"] = f"SELECT doc_id, {_redact('text')} AS redacted, {_n(_count_secrets('text'))} AS secrets FROM documents"
    placed = """list_transform(range(1, len(hits) + 1), lambda i: {'hit': hits[i],
    'b': list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0)})"""
    sql["pii_entities"] = f"""WITH {_pieces('documents', 'doc_id', 'text')},
spans AS (SELECT doc_id, unnest({placed}) AS s FROM pieces)
SELECT doc_id, {_type_of('s.hit')} AS entity_type, CAST(s.b AS INTEGER) AS begin_at, CAST(s.b + len(s.hit) AS INTEGER) AS end_at FROM spans"""
    sql["page_entities"] = f"""WITH {_pieces('pages', 'page_id', 'html')}, hit AS (SELECT page_id, unnest(hits) AS h FROM pieces)
SELECT page_id, {_type_of('h')} AS entity_type, count(*) AS entities FROM hit GROUP BY 1, 2"""
    types = f"array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: {_type_of('h')}))), ',')"
    redacted = _pieces("documents", "doc_id, lang, text AS original", _redact("text"))
    secrets = _n(f"CASE WHEN t <> original THEN {_count_secrets('original')} ELSE 0 END")
    sql["document_redaction"] = f"""WITH {redacted}
SELECT doc_id, {_FILLED} AS text, len(hits) > 0 AS pii_detected, {types} AS entity_types, {secrets} AS secrets_found FROM pieces"""
    sql["redaction_summary"] = f"""WITH {redacted}
SELECT lang, count(*) AS records, count(*) FILTER (WHERE len(hits) > 0) AS pii_detected, {_n(f'sum({secrets})')} AS secrets_found
FROM pieces GROUP BY lang"""
    sql["span_redaction"] = f"WITH {_pieces('documents', 'doc_id', 'text')} SELECT doc_id, {_FILLED} AS text FROM pieces"

    sql["nested_span_redaction"] = f"""WITH {_pieces('documents', 'doc_id', 'text')},
spans AS (SELECT doc_id, len(t) AS size, unnest({placed}) AS s FROM pieces),
marked AS (
  SELECT doc_id, s.b AS b, s.b + len(s.hit) AS e, {_mark_of('s.hit')} AS p FROM spans
  UNION ALL SELECT doc_id, greatest(0, s.b - 60), least(size, s.b + len(s.hit) + 25), '[CONTEXT]' FROM spans),
reach AS (
  SELECT *, row_number() OVER o AS k,
         coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY b, e, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last
  FROM marked WINDOW o AS (PARTITION BY doc_id ORDER BY b, e, p)),
cut AS (
  SELECT doc_id, max(r.e) AS tail, string_agg(substr(t, CAST(r.last + 1 AS BIGINT), CAST(greatest(r.b - r.last, 0) AS BIGINT)) || r.p, '' ORDER BY r.k) AS head
  FROM reach r JOIN clean USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN head IS NULL THEN t ELSE head || substr(t, CAST(tail + 1 AS BIGINT)) END AS text FROM clean LEFT JOIN cut USING (doc_id)"""
    sql["planted_secrets"] = f"""WITH planted AS (SELECT doc_id, {star.SECRETS_SQL} AS text FROM documents),
found AS (SELECT doc_id, {_redact('text')} AS redacted, {_n(_count_secrets('text'))} AS secrets FROM planted)
SELECT *, secrets = 0 AS untouched FROM found"""

    best = """greatest(
      CASE WHEN contains(p, '. ') THEN length(p) - instr(reverse(p), ' .') - 1 ELSE -1 END,
      CASE WHEN contains(p, chr(10)) THEN length(p) - instr(reverse(p), chr(10)) ELSE -1 END)"""
    fits = f"list_max(list_filter(range({CHUNK_BYTES // 4}, {CHUNK_BYTES} + 1), lambda n: strlen(left(rest, n)) <= {CHUNK_BYTES}))"
    sql["text_chunks"] = f"""WITH RECURSIVE steps AS (
  SELECT doc_id, -1 AS position, '' AS chunk, text AS rest, false AS done FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, position + 1, left(rest, cut), substr(rest, cut + 1), last FROM (
    SELECT *, CASE WHEN last THEN length(rest) WHEN {best} > 0 THEN {best} + 1 ELSE length(p) END AS cut FROM (
      SELECT *, strlen(rest) <= {CHUNK_BYTES} AS last, left(rest, CAST({fits} AS BIGINT)) AS p FROM steps WHERE NOT done)))
SELECT doc_id, position, chunk FROM steps WHERE position >= 0"""

    sql["project_risk_summary"] = f"""WITH {HEADS} {_levels()}
SELECT project_key, count(*) AS total_tickets, {LEVEL_COUNTS}, {_r(_mean('risk_score'), 4)} AS avg_risk_score FROM scored GROUP BY project_key"""
    rated = f"WITH {FEATURES}, {MESSAGES} {_series()} {MOOD} {WITH_MOOD} {_levels('rated')}"
    sql["risk_table"] = f"""WITH {FEATURES} {_levels('features')}
SELECT issue_key, substr(summary, 1, 60) AS summary, status, {_percent('risk_score')} AS score, risk_level,
  {_fixed('days_in_status', 0)} || 'd' AS days, dependency_count AS dependencies, risk_score FROM scored"""
    sql["radar_points"] = f"{rated} {RADAR} SELECT * FROM points"
    sql["radar_axes"] = f"""{rated} {RADAR}
SELECT project_key, least(0.0, min(x)) AS x_min, {_r('CASE WHEN max(x) * 1.1 = 0 THEN 10 ELSE max(x) * 1.1 END', 6)} AS x_max,
  least(-1.0, min(y)) AS y_min, greatest(1.0, max(y)) AS y_max FROM points GROUP BY project_key"""
    sql["ticket_lookup"] = f"""WITH {FEATURES} {_levels('features')} {FACTORS.format('scored')}
SELECT f.issue_key, f.project_key, s.risk_score, s.risk_level, f.rank, f.feature, f.value, f.importance,
  split_part(f.issue_key, '-', 1) AS key_project
FROM factors f JOIN scored s USING (issue_key) WHERE s.k = (SELECT max(k) FROM heads)"""
    sql["report_facts"] = f"WITH {HEADS} {_levels()} {FACTS} SELECT * FROM facts"
    sql["high_risk_digest"] = f"WITH {FEATURES} {_levels('features')} {DIGEST} SELECT * FROM high_digest"
    sql["score_digest"] = f"WITH {HEADS} {_levels()} {SCORE_DIGEST} SELECT * FROM score_digest"
    moods = f"{MESSAGES} {_series()} {_anomalies()} {FIRST} {MOOD} {SENTIMENT_DIGEST}"
    sql["sentiment_digest"] = f"WITH {moods} SELECT * FROM sentiment_digest"
    lines = [
        f"'Write the weekly status report of project ' || project_key || ' for {PERIOD}.'",
        "'Tickets: ' || total_tickets",
        "'Completed: ' || completed",
        "'In progress: ' || in_progress",
        "'High risk: ' || high_risk",
        "'Medium risk: ' || medium_risk",
        "'Low risk: ' || low_risk",
        "'<tickets>'",
        "high_risk_digest",
        "'</tickets>' || chr(10) || '<sentiment>'",
        f"coalesce(sentiment_digest, '{fv.NO_SENTIMENT_TEXT}')",
        "'</sentiment>' || chr(10) || '<scores>'",
        "score_digest",
        "'</scores>' || chr(10) || 'Answer with one JSON object with the keys " + ", ".join(REPORT_KEYS) + ".'",
    ]
    sql["report_context"] = f"""WITH {FEATURES} {_levels('features')} {FACTS} {DIGEST} {SCORE_DIGEST}, {moods}
SELECT project_key, concat_ws(chr(10), {', '.join(lines)}) AS prompt
FROM facts LEFT JOIN high_digest USING (project_key) LEFT JOIN score_digest USING (project_key) LEFT JOIN sentiment_digest USING (project_key)"""
    sql["classification_prompts"] = f"""WITH {TICKETS}
SELECT issue_key, concat_ws(chr(10), 'Name the category, complexity_assessment and rationale of this ticket as JSON.', 'Key: ' || issue_key,
  'Summary: ' || summary, 'Description: ' || substr(description, 1, 500), 'Type: ' || issue_type, 'Status: ' || status,
  'Story Points: ' || CAST(coalesce(points, 0.0) AS VARCHAR)) AS prompt FROM tickets"""
    sql["explanation_prompts"] = f"""WITH {FEATURES} {_levels('features')} {FACTORS.format('scored')},
fl AS (SELECT issue_key, string_agg('- ' || feature || ': value=' || CAST(value AS VARCHAR) || ', importance=' || CAST(importance AS VARCHAR), chr(10) ORDER BY rank) AS lines
  FROM factors GROUP BY 1)
SELECT issue_key, concat_ws(chr(10), 'Explain in two or three sentences why this ticket is at risk.', 'Key: ' || issue_key, 'Summary: ' || summary,
  'Status: ' || status, 'Risk Score: ' || {_percent('risk_score')}, 'Risk Level: ' || risk_level, lines, '{fv.NO_CONTEXT_TEXT}') AS prompt
FROM scored JOIN fl USING (issue_key)"""
    sql["anomaly_prompts"] = f"""WITH {MESSAGES} {_series()} {_anomalies()} {FIRST}
SELECT project_key, window_start, 'Sentiment of project ' || project_key || ' dropped in the window ' || window_start || ' to ' || {_fixed('avg_sentiment', 3)}
  || ' (z-score ' || {_fixed('z_score', 2)} || ') over ' || message_count || ' messages. Answer with JSON keys hypothesis, recommended_action, severity (low, medium, high).' AS prompt
FROM first_anomalies"""

    sql["reply_parse"] = """SELECT event_id,
  CASE WHEN event_type IN ('click', 'error', 'purchase') THEN 'load ' || event_id END AS hypothesis,
  CASE WHEN event_type IN ('click', 'error', 'purchase') THEN 'high' END AS severity,
  event_type IN ('signup', 'view') AS parse_error,
  CASE event_type WHEN 'signup' THEN 'No JSON in reply ' || event_id WHEN 'view' THEN 'Broken {"hypothesis": ' || event_id || ',}' END AS raw_response
FROM events"""
    sql["cited_tickets"] = """SELECT event_id, CAST(r AS INTEGER) AS risk_position, CAST(p AS INTEGER) AS position, t || '-' || event_id AS ticket
FROM events CROSS JOIN (VALUES (0, 0, 'A'), (0, 1, 'B'), (1, 0, 'C')) c(r, p, t) WHERE event_type IN ('click', 'error', 'purchase')"""
    sql["anomaly_analysis"] = f"""WITH {MESSAGES} {_series('hour')} {_anomalies()} {FIRST}
SELECT project_key, window_start, z_score, anomaly_rank,
  CASE WHEN message_count % 2 = 1 THEN '{{"hypothesis":"' || message_count || ' messages","severity":"low"}}'
    ELSE '{{"hypothesis":"LLM analysis unavailable","severity":"unknown"}}' END AS analysis FROM first_anomalies"""

    sql["sprint_parse"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_linenumber AS VARCHAR) AS sprint_id,
  CASE l_linenumber WHEN 3 THEN 'New 3' WHEN 5 THEN 'a=b 5' ELSE 'Sprint ' || l_linenumber END AS sprint_name, l_linestatus AS sprint_state,
  strftime(l_shipdate, '%Y-%m-%d') AS start_date, CAST(NULL AS VARCHAR) AS end_date, CAST(NULL AS VARCHAR) AS complete_date
FROM lineitem WHERE l_linenumber <> 1"""
    sql["issue_flatten"] = f"""SELECT CAST(o_orderkey AS VARCHAR) AS issue_id, c_mktsegment || '-' || o_orderkey AS issue_key, c_mktsegment AS project_key,
  'Order ' || o_orderkey AS summary, CASE WHEN o_orderkey % 11 <> 0 THEN {_DESCRIPTION} END AS description,
  {_case('o_orderstatus', star.STATUS)} AS status, {_case('o_orderstatus', star.STATUS)} AS status_category,
  {_case('o_orderpriority', star.PRIORITY)} AS priority, {_case('o_orderkey % 7', _TYPES, "'Other'")} AS issue_type,
  CASE WHEN o_custkey % 17 <> 0 THEN 'engineer_' || (o_custkey % 50) END AS assignee, 'pm_' || (o_custkey % 5) AS reporter,
  {_CREATED} AS created, {_CREATED} AS updated, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due_date,
  CAST(NULL AS VARCHAR) AS resolution_date, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 14 AS DOUBLE) END AS story_points,
  'backend,' || {_case('o_orderstatus', star.STATUS)} AS labels, 'part ' || (o_orderkey % 9) AS components,
  CASE o_orderkey % 3 WHEN 0 THEN {_SPRINT_OBJECT} WHEN 1 THEN {_SPRINT_OBJECT} || ';' || {_SPRINT_TEXT} ELSE '' END AS sprint_history,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Blocks|outward|' || c_mktsegment || '-' || (o_orderkey + 1) || ';Relates|inward|' || c_mktsegment || '-' || (o_orderkey + 1) ELSE '' END AS issue_links,
  o_orderkey % 21 AS comment_count, '{star.AS_OF}' AS ingested_at FROM {_BASE}"""
    sql["message_flatten"] = f"""WITH m AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, {_case('event_type', star.EVENT_TEXT)} AS text FROM events),
kept AS (SELECT * FROM m WHERE event_type NOT IN ('signup', 'view')) {_scores('kept', 'text', 'event_id')}
SELECT 'C' || (user_id % 5) AS channel_id, CAST(event_id AS VARCHAR) AS message_ts, 'U' || user_id AS user_id, text, coalesce(score, 0.0) AS sentiment_score,
  CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS reply_count, CASE WHEN k % 3 <> 0 THEN k + 1 ELSE 0 END AS reaction_count,
  {_iso('make_timestamp(event_id * 1000000)')} AS datetime_utc, '{star.AS_OF}' AS ingested_at FROM kept LEFT JOIN scores USING (event_id)"""
    sql["page_rejects"] = """SELECT CAST(o_orderkey AS VARCHAR) AS issue_id,
  CASE WHEN o_orderkey % 50 = 7 THEN 'rejected' ELSE 'read' END AS outcome FROM orders"""
    link = """'{"type":"' || a || '","direction":"' || b || '","linked_issue":"' || c_mktsegment || '-' || (o_orderkey + 1) || '"}'"""
    blocks = link.replace("' || a || '", "Blocks").replace("' || b || '", "outward")
    relates = link.replace("' || a || '", "Relates").replace("' || b || '", "inward")
    sql["nested_json"] = f"""SELECT c_mktsegment || '-' || o_orderkey AS issue_key,
  '["backend","' || {_case('o_orderstatus', star.STATUS)} || '"]' AS labels, '["part ' || (o_orderkey % 9) || '"]' AS components,
  CASE WHEN o_orderkey % 4 = 0 THEN '[' || {blocks} || ',' || {relates} || ']' ELSE '[]' END AS issue_links FROM {_BASE}"""
    sql["key_validation"] = f"""WITH keys AS (
  SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment || '-1' ELSE c_mktsegment END AS project_key,
    CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment || '-' ELSE c_mktsegment || '-' || (o_orderkey * 1003) END AS issue_key FROM {_BASE})
SELECT *, regexp_full_match(project_key, '[A-Z][A-Z0-9_]{{1,19}}') AS project_ok, regexp_full_match(issue_key, '[A-Z][A-Z0-9_]{{1,19}}-[0-9]{{1,7}}') AS issue_ok,
  split_part(issue_key, '-', 1) AS project FROM keys"""
    sql["split_keys"] = f"""WITH keys AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment || '-' ELSE c_mktsegment || '-' || (o_orderkey * 1003) END AS issue_key FROM {_BASE})
SELECT *, regexp_full_match(issue_key, '[A-Z][A-Z0-9_]{{1,19}}-[0-9]{{1,7}}') AS valid FROM keys"""
    sql["export_clean"] = f"""WITH {HEADS}
SELECT issue_key, strftime(created, '%Y-%m-%dT%H:%M:%S+00:00') AS created, strftime(due_date, '%Y-%m-%dT%H:%M:%S+00:00') AS due_date,
  CASE WHEN k % 4 <= 1 THEN 0.0 ELSE {_r('k / 7', 4)} END AS odd, {_r('rule_score', 4)} AS risk_score FROM heads"""

    sql["latest_tickets"] = f"""WITH {HEADS}
SELECT issue_key, project_key, status, {_iso('updated + to_days(CAST(k % 4 AS INTEGER))')} AS updated, CAST(k % 4 AS INTEGER) AS version,
  'run-' || (k % 4) AS ingested_at FROM heads"""
    marks = "marks AS (SELECT project_key, max(created) AS mark FROM heads WHERE project_key <> 'MACHINERY' GROUP BY 1)"
    sql["incremental_tickets"] = f"""WITH {HEADS}, {marks}
SELECT issue_key, project_key, {_iso('updated')} AS updated FROM heads LEFT JOIN marks USING (project_key) WHERE mark IS NULL OR updated >= mark"""
    sql["advanced_marks"] = f"""WITH {HEADS}, {marks}
SELECT h.project_key, CASE WHEN h.project_key IN ('BUILDING', 'FURNITURE') THEN strftime(any_value(mark), '%Y-%m-%d %H:%M')
  ELSE strftime(max(updated), '%Y-%m-%dT%H:%M:%S.%fZ') END AS last_ingest_date
FROM heads h LEFT JOIN marks USING (project_key) GROUP BY 1"""
    sql["recent_messages"] = f"""WITH {MESSAGES}
SELECT event_id, channel_id, {_iso('ts')} AS datetime_utc FROM messages WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'"""
    sql["ingestion_summary"] = f"""WITH {HEADS}, c AS (
  SELECT project_key, count(*) AS tickets_ingested, count(*) FILTER (WHERE k % 11 <> 0) AS pii_detected, count(priority) / count(*) AS done FROM heads GROUP BY 1)
SELECT project_key, tickets_ingested, pii_detected, done >= 0.8 AS quality_passed, CAST(done < 0.8 AS BIGINT) AS quality_violations, 'success' AS status FROM c
UNION ALL SELECT 'IDLE', 0, 0, NULL, NULL, 'no_new_data' UNION ALL SELECT 'BROKEN', 0, 0, NULL, NULL, 'error'"""
    sql["lake_roundtrip"] = f"""WITH {HEADS}
SELECT issue_key, project_key, status, rule_score, day AS silver_date, project_key AS project, '2024-01-04' AS date,
  CASE WHEN day = '2024-01-02' AND project_key IN ('BUILDING', 'MACHINERY') THEN true END AS filtered
FROM heads CROSS JOIN (VALUES ('2024-01-02'), ('2024-01-03')) d(day) WHERE day = '2024-01-02' OR status = 'Done'"""
    sql["newest_silver"] = f"""WITH {HEADS}
SELECT issue_key, {_iso('updated + to_days(CAST(k % 4 AS INTEGER))')} AS updated, CAST(k % 4 AS INTEGER) AS version FROM heads"""
    sql["repeated_load"] = f"""WITH {HEADS}
SELECT project_key, count(*) AS tickets, CAST(count(priority) / count(*) < 0.8 AS BIGINT) AS alerts FROM heads GROUP BY 1"""
    landed = f"""numbered AS (SELECT project_key, row_number() OVER (PARTITION BY project_key ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY project_key) AS n FROM heads),
whole AS (SELECT project_key, pos // {star.PAGE_SIZE} AS page, min(pos) AS s, max(pos) + 1 AS e, any_value(n) AS n, project_key <> 'MACHINERY' AS hurt FROM numbered GROUP BY 1, 2),
pages AS (SELECT *, hurt AND page % 17 = 5 AS lost, hurt AND page % 17 <> 5 AND page % 23 = 7 AS cut,
  hurt AND page % 17 <> 5 AND page % 23 <> 7 AND page % 29 = 3 AS twice FROM whole)"""
    sql["page_sets"] = f"""WITH {HEADS}, {landed}
SELECT project_key, count(*) FILTER (WHERE NOT lost) + count(*) FILTER (WHERE twice) AS pages, count(*) FILTER (WHERE cut) AS rejects, any_value(n) AS total,
  {_n('sum(CASE WHEN lost OR cut THEN 0 WHEN twice THEN 2 * (e - s) ELSE e - s END)')} AS received,
  {_n('sum(CASE WHEN twice THEN e - s ELSE 0 END)')} AS repeated, {_n('sum(CASE WHEN lost OR cut THEN e - s ELSE 0 END)')} AS missing,
  NOT bool_or(lost OR cut) AS complete FROM pages GROUP BY 1"""
    sql["page_gaps"] = f"""WITH {HEADS}, {landed},
runs AS (SELECT *, page - row_number() OVER (PARTITION BY project_key ORDER BY page) AS run FROM pages WHERE lost OR cut)
SELECT project_key, min(s) AS gap_start, max(e) AS gap_end FROM runs GROUP BY project_key, run"""
    sql["page_load"] = f"""WITH {HEADS}, {landed}
SELECT project_key, CASE WHEN bool_or(lost OR cut) THEN 'error' ELSE 'success' END AS status,
  {_n('sum(CASE WHEN lost OR cut THEN 0 WHEN twice THEN 2 * (e - s) ELSE e - s END)')} AS tickets_ingested,
  count(*) FILTER (WHERE cut) AS rejects, NOT bool_or(lost OR cut) AS marked FROM pages GROUP BY 1"""
    sql["stream_lake"] = f"""WITH {HEADS}, {landed}, c AS (
  SELECT project_key, {_n('sum(CASE WHEN lost OR cut THEN 0 WHEN twice THEN 2 * (e - s) ELSE e - s END)')} AS silver, count(*) FILTER (WHERE cut) AS rejects FROM pages GROUP BY 1)
SELECT project_key, silver, silver AS bronze, rejects FROM c"""
    sql["updated_table"] = f"""WITH {HEADS}
SELECT issue_key, project_key, CAST(NULL AS VARCHAR) AS status, '2024-01-01' AS date FROM heads
UNION ALL SELECT issue_key, project_key, status, '2024-01-02' FROM heads WHERE status = 'Done'"""
    sql["united_schemas"] = f"""WITH {HEADS}
SELECT issue_key, CASE k % 3 WHEN 0 THEN k WHEN 1 THEN k + 8589934592 END AS size, CASE WHEN k % 3 = 1 THEN status END AS status,
  '2024-01-0' || (k % 3 + 1) AS date FROM heads"""
    sql["repeated_gold"] = f"""WITH {HEADS}
SELECT issue_key, CASE WHEN project_key IN ('BUILDING', 'MACHINERY') THEN 'second' ELSE 'first' END AS run_of FROM heads
WHERE project_key NOT IN ('BUILDING', 'MACHINERY') OR k % 2 = 0"""
    sql["merged_marks"] = f"""WITH {HEADS}, {marks}
SELECT h.project_key, CASE WHEN h.project_key NOT IN ('BUILDING', 'MACHINERY') THEN strftime(any_value(mark), '%Y-%m-%d %H:%M')
  ELSE strftime(max(updated), '%Y-%m-%dT%H:%M:%S.%fZ') END AS last_ingest_date
FROM heads h LEFT JOIN marks USING (project_key) GROUP BY 1"""
    sql["message_load"] = """SELECT 'C' || (user_id % 5) AS project_key, 2 * count(*) AS messages, count(*) AS in_series
FROM events WHERE event_type NOT IN ('signup', 'view') GROUP BY 1"""
    sql["expired_bronze"] = f"WITH {HEADS} SELECT project_key, '2024-02-15' AS date, count(*) AS tickets FROM heads GROUP BY 1"
    sql["catalog_table"] = f"""WITH {HEADS}
SELECT project_key AS project, '2024-01-04' AS date, count(*) AS tickets, max(rule_score) AS top FROM heads GROUP BY 1"""
    sql["feedback"] = f"""WITH {HEADS}, f AS (
  SELECT CASE WHEN k % 6 = 0 THEN lower(project_key) ELSE project_key END AS project_key,
    CASE k % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'praised' WHEN 2 THEN 'rejected' ELSE 'edited' END AS feedback_type, k FROM heads)
SELECT project_key, feedback_type, '{star.AS_OF}' AS timestamp, k % 6 <> 0 AND k % 4 <> 1 AS stored, count(*) AS records FROM f GROUP BY ALL"""

    closed = _series(where=_STREAM_CLOSED)
    sql["stream_sentiment"] = sql["sentiment_timeseries_day"]
    sql["stream_dedup"] = f"WITH {MESSAGES} SELECT event_id, channel_id, user_id FROM messages"
    sql["stream_silver"] = f"""SELECT c_mktsegment || '-' || o_orderkey AS issue_key, c_mktsegment AS project, '2001-12-01' AS date,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'Ask [EMAIL] about host [IP_ADDRESS] and order ' || o_orderkey END AS description,
  o_orderkey % 11 <> 0 AS pii_detected, CASE WHEN o_orderkey % 11 <> 0 THEN 'EMAIL,IP_ADDRESS' ELSE '' END AS entity_types FROM {_BASE}"""
    sql["stream_quality_alerts"] = f"""WITH {HEADS}
SELECT '{fv.QUALITY_ALERT}' AS alert_type, project_key, CAST(1 AS BIGINT) AS violations, '{star.AS_OF}' AS created_at
FROM heads GROUP BY project_key HAVING count(priority) / count(*) < 0.8"""
    shown = "SELECT project_key, window_start, avg_sentiment, z_score, anomaly_type FROM anomalies"
    sql["stream_anomalies"] = f"WITH {MESSAGES} {_series()} {_anomalies()} {shown}"
    sql["stream_closed_anomalies"] = f"WITH {MESSAGES} {closed} {_anomalies()} {shown}"
    return sql
