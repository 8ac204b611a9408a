"""ANSI SQL for the registered queries, written from the definitions.

The SQL scans once per attribute and metric, compares rows pairwise and uses no cells, so it shares
no algebra with the Spark operators it checks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from evenhand.functions.stats import ERFC_COEFFICIENTS, HASH_MODULUS, HASH_MULTIPLIER
from evenhand.plans.inputs import CHECK_DOMAINS, CUTOFFS, EXPLAINED_SCORE, POLICY, RULES, SCORE, STEPS

AGE_BAND = """CASE WHEN age IS NULL THEN NULL WHEN age <= 24 THEN '18-24' WHEN age <= 34 THEN '25-34'
    WHEN age <= 44 THEN '35-44' WHEN age <= 54 THEN '45-54' WHEN age <= 64 THEN '55-64' ELSE '65+' END"""

APPLICATIONS = f"""
base AS (
  SELECT o_orderkey AS application_id, o_orderdate AS application_date, c_mktsegment AS race,
    o_orderstatus AS gender, CAST(18 + (o_custkey * 13 + 7) % 62 AS INT) AS age, r_name AS region,
    n_name AS zip_code,
    CASE o_custkey % 3 WHEN 0 THEN 'Urban' WHEN 1 THEN 'Suburban' ELSE 'Rural' END AS urban_rural,
    CAST(15000 + (o_custkey * 7919) % 185001 AS DOUBLE) AS annual_income,
    CAST(300 + (o_orderkey * 37 + o_custkey * 101) % 551 AS INT) AS credit_score,
    CAST((o_orderkey * 31) % 800 AS DOUBLE) / 1000e0 AS debt_to_income,
    CAST(o_orderkey % 5 AS INT) AS existing_loans,
    CASE WHEN (o_orderkey * 17) % 10 = 0 THEN 1 ELSE 0 END AS previous_defaults,
    o_orderpriority AS loan_type, o_totalprice AS loan_amount,
    CAST(12 * (o_orderkey % 3 + 1) AS INT) AS loan_term_months,
    3e0 + CAST((o_orderkey * 53) % 1200 AS DOUBLE) / 100e0 AS interest_rate_requested,
    CAST((o_orderkey * 7919 + o_custkey * 104729) % 1000 AS DOUBLE) / 1000e0 AS draw,
    8e-1 + CAST((o_orderkey * 13) % 200 AS DOUBLE) / 1000e0 AS granted_share
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey),
scored AS (
  SELECT *, {AGE_BAND} AS age_group,
    CAST(greatest(0, age - 18 - application_id % 5) AS INT) AS employment_years,
    CAST(credit_score - 300 AS DOUBLE) / 550e0 * 0.7e0 + (1e0 - debt_to_income) * 0.3e0 AS predicted_probability,
    gender = 'F' AS is_female, race IN ('BUILDING', 'FURNITURE') AS is_minority
  FROM base),
likely AS (
  SELECT *, CASE WHEN predicted_probability > 0.5e0 THEN 1 ELSE 0 END AS predicted,
    least(greatest(predicted_probability * (CASE WHEN is_female THEN 0.85e0 ELSE 1e0 END)
      * (CASE WHEN is_minority THEN 0.75e0 ELSE 1e0 END)
      * (CASE WHEN age < 25 OR age > 65 THEN 0.8e0 ELSE 1e0 END)
      * (CASE WHEN region IN ('AFRICA', 'ASIA') THEN 0.85e0 ELSE 1e0 END)
      * (CASE WHEN is_female AND is_minority THEN 0.9e0 ELSE 1e0 END), 0e0), 1e0) AS approval_probability
  FROM scored),
decided AS (SELECT *, CASE WHEN draw < approval_probability THEN 1 ELSE 0 END AS approved FROM likely),
applications AS (
  SELECT *, zip_code || '/' || urban_rural AS tract,
    CASE WHEN approved = 1 THEN loan_amount * granted_share ELSE 0e0 END AS approved_amount,
    CASE WHEN approved = 1 THEN 5e0 + CAST(850 - credit_score AS DOUBLE) / 100e0
      + (CASE WHEN is_minority THEN 0.5e0 ELSE 0e0 END) + (CASE WHEN is_female THEN 0.3e0 ELSE 0e0 END)
      ELSE 0e0 END AS approved_interest_rate,
    CASE WHEN race = 'BUILDING' THEN 1 ELSE 0 END AS "race_BUILDING",
    CASE WHEN gender = 'F' THEN 1 ELSE 0 END AS "gender_F",
    CASE WHEN region = 'AFRICA' THEN 1 ELSE 0 END AS "region_AFRICA"
  FROM decided)"""

FLAWED = """
planted AS (
  SELECT application_id, CASE WHEN application_id % 79 = 0 THEN NULL ELSE race END AS race, gender,
    CASE WHEN application_id % 101 = 0 THEN NULL WHEN application_id % 97 = 0 THEN 17 ELSE age END AS age,
    annual_income, CASE WHEN application_id % 89 = 0 THEN 900 ELSE credit_score END AS credit_score,
    CASE WHEN application_id % 73 = 0 THEN age ELSE employment_years END AS employment_years,
    CASE WHEN application_id % 83 = 0 THEN 2.5e0 ELSE debt_to_income END AS debt_to_income,
    loan_type, loan_amount, approved,
    CASE WHEN application_id % 71 = 0 THEN loan_amount * 1.1e0 WHEN application_id % 67 = 0 THEN 0e0
      ELSE approved_amount END AS approved_amount
  FROM applications),
flawed AS (SELECT * FROM planted UNION ALL SELECT * FROM planted WHERE application_id % 61 = 0)"""


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",".join((APPLICATIONS, *ctes)) + "\n" + select


def hashed(key: str, salt: int = 0) -> str:
    return f"((({key} % {HASH_MODULUS}) * {HASH_MULTIPLIER} + {104729 + salt}) % {HASH_MODULUS})"


def rnd(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0e0 AS {name}"


def number(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def erfc(z: str) -> str:
    t = f"(1e0 / (1e0 + 0.5e0 * {z}))"
    poly = number(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({number(c)} + {t} * {poly})"
    return f"({t} * exp(-{z} * {z} + {poly}))"


# Metric names, thresholds and regulations as SQL rows.
METRIC_INFO = """
metric_info(metric, metric_name, threshold, regulation) AS (VALUES
  ('four_fifths_rule', 'Disparate Impact (Four-Fifths Rule)', 0.8e0, 'ECOA'),
  ('demographic_parity', 'Demographic Parity Difference', 0.1e0, 'Fair Housing Act'),
  ('equal_opportunity', 'Equal Opportunity Difference', 0.1e0, 'ECOA'),
  ('predictive_parity', 'Predictive Parity', 0.1e0, 'ECOA'),
  ('equalized_odds', 'Equalized Odds', 0.1e0, 'ECOA'),
  ('intersectional_summary', 'Intersectional Disparity', 0.2e0, NULL))"""


def metric_ctes(
    attributes: Mapping[str, str] | Sequence[str],
    segment: str = "'all'",
    outcome: str = "approved",
    source: str = "applications",
    references: Mapping[str, str] | None = None,
    prefix: str = "",
) -> str:
    """CTEs ending in ``{prefix}metrics(seg, attribute, metric, ...)``, one scan per attribute."""
    if not isinstance(attributes, Mapping):
        attributes = {a: a for a in attributes}
    given = "".join(f" WHEN '{a}' THEN '{g}'" for a, g in (references or {}).items())
    requested = f"CASE attribute{given} ELSE NULL END" if given else "CAST(NULL AS VARCHAR)"
    groups = " UNION ALL ".join(
        f"""SELECT {segment} AS seg, '{a}' AS attribute, CAST({e} AS VARCHAR) AS grp, count(*) AS n,
      sum({outcome}) AS y, avg(CAST({outcome} AS DOUBLE)) AS rate,
      avg(CASE WHEN credit_score > 650 THEN CAST({outcome} AS DOUBLE) END) AS tpr,
      avg(CASE WHEN credit_score <= 650 THEN CAST({outcome} AS DOUBLE) END) AS fpr,
      avg(CASE WHEN predicted_probability > 0.5e0 THEN CAST({outcome} AS DOUBLE) END) AS prec
    FROM {source} WHERE {e} IS NOT NULL AND {outcome} IS NOT NULL GROUP BY 1, 2, 3"""
        for a, e in attributes.items()
    )
    p = prefix
    gap = "CASE WHEN v < 0.1e0 THEN 'Low' WHEN v < 0.2e0 THEN 'Medium' ELSE 'High' END"
    chi = f"(SELECT c.chi FROM {p}chi c WHERE c.seg = b.seg AND c.attribute = b.attribute)"
    return f"""{METRIC_INFO if not prefix or prefix == 'a_' else 'unused_' + prefix + ' AS (SELECT 1)'},
{p}groups AS ({groups}),
{p}wanted AS (SELECT *, {requested} AS requested FROM {p}groups),
{p}refs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg, attribute
    ORDER BY CASE WHEN grp = requested THEN 0 ELSE 1 END, rate DESC, grp) AS k FROM {p}wanted) WHERE k = 1),
{p}qrefs AS (SELECT seg, attribute, coalesce(max(requested), min(grp) FILTER (WHERE k = 1)) AS grp,
    CASE WHEN max(requested) IS NULL THEN max(tpr) ELSE coalesce(max(tpr) FILTER (WHERE grp = requested), 0e0) END AS tpr
  FROM (SELECT *, row_number() OVER (PARTITION BY seg, attribute ORDER BY tpr DESC, grp) AS k
    FROM {p}wanted WHERE tpr IS NOT NULL) GROUP BY seg, attribute),
{p}ratios AS (SELECT g.*, r.grp AS ref, g.rate / r.rate AS ratio, row_number() OVER (
    PARTITION BY g.seg, g.attribute ORDER BY g.rate / r.rate, g.grp) AS k
  FROM {p}groups g JOIN {p}refs r ON g.seg = r.seg AND g.attribute = r.attribute
  WHERE g.grp <> r.grp AND r.rate > 0),
{p}di AS (SELECT r.seg, r.attribute, r.grp AS ref, coalesce(x.ratio, 1e0) AS v, x.grp AS worst
  FROM {p}refs r LEFT JOIN {p}ratios x ON r.seg = x.seg AND r.attribute = x.attribute AND x.k = 1),
{p}tables AS (SELECT d.seg, d.attribute,
    sum(CASE WHEN g.grp IN (d.ref, d.worst) THEN y ELSE 0 END) * 1e0 AS a,
    sum(CASE WHEN g.grp IN (d.ref, d.worst) THEN n - y ELSE 0 END) * 1e0 AS b,
    sum(CASE WHEN g.grp IN (d.ref, d.worst) THEN 0 ELSE y END) * 1e0 AS c,
    sum(CASE WHEN g.grp IN (d.ref, d.worst) THEN 0 ELSE n - y END) * 1e0 AS d
  FROM {p}di d JOIN {p}groups g ON d.seg = g.seg AND d.attribute = g.attribute
  WHERE d.worst IS NOT NULL GROUP BY d.seg, d.attribute),
{p}chi AS (SELECT seg, attribute, coalesce((a + b + c + d)
      * power(greatest(abs(a * d - b * c) - (a + b + c + d) / 2e0, 0e0), 2)
      / nullif((a + b) * (c + d) * (a + c) * (b + d), 0), 0e0) AS chi FROM {p}tables),
{p}dp AS (SELECT g.seg, g.attribute, r.grp AS ref, abs(g.rate - r.rate) AS diff, g.grp,
    row_number() OVER (PARTITION BY g.seg, g.attribute ORDER BY abs(g.rate - r.rate) DESC, g.grp) AS k
  FROM {p}groups g JOIN {p}refs r ON g.seg = r.seg AND g.attribute = r.attribute),
{p}eo AS (SELECT g.seg, g.attribute, r.grp AS ref, abs(g.tpr - r.tpr) AS diff, g.grp,
    row_number() OVER (PARTITION BY g.seg, g.attribute ORDER BY abs(g.tpr - r.tpr) DESC, g.grp) AS k
  FROM {p}groups g JOIN {p}qrefs r ON g.seg = r.seg AND g.attribute = r.attribute
  WHERE g.tpr IS NOT NULL AND g.grp <> r.grp),
{p}spread AS (SELECT seg, attribute, coalesce(max(prec) - min(prec), 0e0) AS pp,
    ((max(coalesce(tpr, 0e0)) - min(coalesce(tpr, 0e0))) + (max(coalesce(fpr, 0e0)) - min(coalesce(fpr, 0e0)))) / 2e0 AS eod,
    max(rate) - min(rate) AS span, min(CASE WHEN w = 1 THEN grp END) AS lowest
  FROM (SELECT *, row_number() OVER (PARTITION BY seg, attribute ORDER BY rate, grp) AS w FROM {p}groups)
  GROUP BY seg, attribute),
{p}values AS (
  SELECT b.seg, b.attribute, 'four_fifths_rule' AS metric, b.v, b.v >= 0.8e0 AS passed,
    CASE WHEN b.v >= 0.8e0 THEN 'Low' WHEN b.v >= 0.7e0 THEN 'Medium' ELSE 'High' END AS severity,
    b.ref AS reference_group, b.worst AS impacted_group, CASE WHEN coalesce({chi}, 0e0) <= 0 THEN 1e0
      ELSE least({erfc(f"sqrt({chi} / 2e0)")}, 1e0) END AS p_value
  FROM {p}di b
  UNION ALL SELECT seg, attribute, 'demographic_parity', diff AS v, diff < 0.1e0, {gap.replace('v <', 'diff <')}, ref,
    CASE WHEN diff > 0 THEN grp END, NULL FROM {p}dp WHERE k = 1
  UNION ALL SELECT s.seg, s.attribute, 'equal_opportunity', coalesce(e.diff, 0e0), coalesce(e.diff, 0e0) < 0.1e0,
    {gap.replace('v <', 'coalesce(e.diff, 0e0) <')}, q.grp, CASE WHEN e.diff > 0 THEN e.grp END, NULL
    FROM {p}spread s LEFT JOIN {p}eo e ON s.seg = e.seg AND s.attribute = e.attribute AND e.k = 1
      LEFT JOIN {p}qrefs q ON s.seg = q.seg AND s.attribute = q.attribute
  UNION ALL SELECT seg, attribute, 'predictive_parity', pp, pp < 0.1e0, {gap.replace('v <', 'pp <')}, NULL, NULL, NULL FROM {p}spread
  UNION ALL SELECT seg, attribute, 'equalized_odds', eod, eod < 0.1e0, {gap.replace('v <', 'eod <')}, NULL, NULL, NULL FROM {p}spread
  UNION ALL SELECT seg, attribute, 'intersectional_summary', span, span < 0.2e0,
    CASE WHEN span > 0.3e0 THEN 'High' WHEN span > 0.2e0 THEN 'Medium' ELSE 'Low' END, NULL, lowest, NULL
    FROM {p}spread WHERE attribute = 'intersectional_group'),
{p}metrics AS (SELECT seg, attribute, metric, metric_name, v AS value, threshold, passed, severity, regulation,
    reference_group, impacted_group, p_value FROM {p}values JOIN metric_info USING (metric))"""


METRIC_COLUMNS = (
    f"attribute, metric, metric_name, {rnd('value', 'value')}, threshold, passed, severity, regulation, "
    f"reference_group, impacted_group, {rnd('p_value', 'p_value')}"
)
AUDITED = ("race", "gender", "age_group")
PROTECTED = (*AUDITED, "region")
REFERENCES = {"race": "MACHINERY", "gender": "O"}


def single_metric(metric: str, references: Mapping[str, str] | None = None) -> str:
    return sql(
        f"SELECT {METRIC_COLUMNS} FROM metrics WHERE metric = '{metric}'",
        metric_ctes(PROTECTED, references=references),
    )


def two_models() -> str:
    return f"""{metric_ctes(AUDITED, prefix='a_')}, {metric_ctes(AUDITED, outcome='predicted', prefix='b_')},
both_models AS (SELECT 'history' AS model, * FROM a_metrics UNION ALL SELECT 'score', * FROM b_metrics)"""


# --- risk ----------------------------------------------------------------------------------------

ASSESSED = """
weights(metric, weight, ord) AS (VALUES ('four_fifths_rule', 0.4e0, 0), ('demographic_parity', 0.2e0, 1),
  ('equal_opportunity', 0.2e0, 2), ('predictive_parity', 0.1e0, 3), ('equalized_odds', 0.1e0, 4)),
risks AS (SELECT m.*, weight, ord, CASE WHEN metric = 'four_fifths_rule' THEN greatest(0e0, 1e0 - value / threshold)
    ELSE least(1e0, value / (threshold * 3e0)) END AS risk FROM metrics m JOIN weights USING (metric)),
overall AS (SELECT seg, attribute, sum(risk * weight ORDER BY ord) / sum(weight ORDER BY ord) AS score,
    string_agg(metric || ':' || CAST(weight AS VARCHAR) || ':' || CAST(CAST(round(risk, 4) AS DECIMAL(10, 4)) AS VARCHAR), ',' ORDER BY ord) AS scores,
    string_agg(CASE WHEN risk > 0.6e0 THEN metric END, ',' ORDER BY ord) AS risky, count(*) FILTER (WHERE risk > 0.6e0) AS n_risky
  FROM risks GROUP BY seg, attribute),
breaches AS (SELECT seg, attribute, 1 AS ord, 'ECOA' AS regulation, 'ECOA: Failed Four-Fifths Rule: ' || severity AS violation
    FROM metrics WHERE metric = 'four_fifths_rule' AND NOT passed
  UNION ALL SELECT seg, attribute, 2, 'Fair Housing Act', 'Fair Housing Act: Demographic Parity violation: ' || severity
    FROM metrics WHERE metric = 'demographic_parity' AND NOT passed),
assessed AS (SELECT o.*, CASE WHEN score < 0.33e0 THEN 'Low' WHEN score < 0.66e0 THEN 'Medium' ELSE 'High' END AS severity,
    CASE WHEN score < 0.33e0 THEN 'green' WHEN score < 0.66e0 THEN 'yellow' ELSE 'red' END AS color,
    coalesce(b.regulations, '') AS regulations, coalesce(b.violations, '') AS violations, coalesce(b.n, 0) AS n_violations
  FROM overall o LEFT JOIN (SELECT seg, attribute, string_agg(regulation, ',' ORDER BY ord) AS regulations,
      string_agg(violation, ',' ORDER BY ord) AS violations, count(*) AS n FROM breaches GROUP BY seg, attribute) b
    ON o.seg = b.seg AND o.attribute = b.attribute),
rules AS (
  SELECT seg, attribute, 1 AS ordinal, 'URGENT_REVIEW' AS code, CAST(NULL AS VARCHAR) AS grp FROM overall WHERE score > 0.66e0
  UNION ALL SELECT seg, attribute, 2, 'REVIEW_CRITERIA', coalesce(impacted_group, 'minority groups') FROM metrics
    WHERE metric = 'four_fifths_rule' AND NOT passed
  UNION ALL SELECT seg, attribute, 3, 'MITIGATE', NULL FROM metrics WHERE metric = 'demographic_parity' AND value > threshold * 1.5e0
  UNION ALL SELECT seg, attribute, 4, 'INVESTIGATE_QUALIFIED', NULL FROM metrics WHERE metric = 'equal_opportunity' AND NOT passed
  UNION ALL SELECT seg, attribute, o.ordinal, o.code, NULL FROM overall, (VALUES (5, 'ANALYZE_FACTORS'),
    (6, 'RETRAIN_BALANCED'), (7, 'MONITOR_FAIRNESS')) o(ordinal, code) WHERE score > 0.33e0),
recommended AS (SELECT seg, attribute, string_agg(CASE WHEN k <= 3 THEN code END, ',' ORDER BY ordinal) AS three,
    string_agg(CASE WHEN k <= 2 THEN code END, ',' ORDER BY ordinal) AS two
  FROM (SELECT *, row_number() OVER (PARTITION BY seg, attribute ORDER BY ordinal) AS k FROM rules) GROUP BY seg, attribute)"""


def assessed(select: str) -> str:
    return sql(select, metric_ctes(AUDITED, segment="tract"), ASSESSED)


# --- linear scores -------------------------------------------------------------------------------


def linear(weights: Mapping[str, float], intercept: float, values: Mapping[str, str] | None = None) -> str:
    z = number(intercept)
    for f, w in weights.items():
        z += f" + {number(w)} * CAST({(values or {}).get(f, chr(34) + f + chr(34))} AS DOUBLE)"
    return f"(1e0 / (1e0 + exp(-({z}))))"


P_SCORE = linear(SCORE.weights, SCORE.intercept)
POLICY_VALUES = {f: f"greatest({f}, {r['value']})" for f, r in POLICY.items()}
P_POLICY = linear(SCORE.weights, SCORE.intercept, POLICY_VALUES)
DECISIONS = f"""
decisions AS (SELECT *, CASE WHEN {P_SCORE} > 0.5e0 THEN 1 ELSE 0 END AS baseline,
  CASE WHEN {P_POLICY} > 0.5e0 THEN 1 ELSE 0 END AS modified FROM applications)"""
CHANGE = ", ".join(
    (
        rnd("avg(baseline)", "baseline_rate"),
        rnd("avg(modified)", "modified_rate"),
        rnd("avg(modified) - avg(baseline)", "change"),
        rnd("CASE WHEN avg(baseline) > 0 THEN (avg(modified) - avg(baseline)) / avg(baseline) * 100 ELSE 0e0 END", "percent_change"),
    )
)
POLICY_DELTAS = " UNION ALL ".join(
    f"""SELECT application_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS before, CAST({v} AS DOUBLE) AS after,
  CAST({v} AS DOUBLE) - CAST({f} AS DOUBLE) AS delta FROM applications WHERE abs({v} - {f}) > 0.1e0"""
    for f, v in POLICY_VALUES.items()
)


def _grid_rows() -> str:
    features = list(STEPS)
    moves = [(a, b, c) for a in STEPS[features[0]] for b in STEPS[features[1]] for c in STEPS[features[2]]]
    kept = [m for m in moves if any(m)]
    return ", ".join(f"({i}, {a}e0, {b}e0, {c}e0)" for i, (a, b, c) in enumerate(kept))


_MOVED = list(STEPS)
CANDIDATES = f"""
spread AS (SELECT {", ".join(f"stddev_pop(CAST({f} AS DOUBLE)) AS sd_{f}" for f in _MOVED)} FROM applications),
grid(candidate_id, {", ".join("m_" + f for f in _MOVED)}) AS (VALUES {_grid_rows()}),
tried AS (SELECT application_id, candidate_id,
    {", ".join(f"CAST({f} AS DOUBLE) + m_{f} * 0.5e0 * sd_{f} AS {f}" if f in _MOVED else f"CAST({f} AS DOUBLE) AS {f}" for f in SCORE.weights)},
    sqrt({" + ".join(f"power(m_{f} * 0.5e0 * sd_{f}, 2)" for f in _MOVED)}) AS proximity
  FROM applications, grid, spread WHERE NOT {P_SCORE} > 0.5e0),
candidates AS (SELECT *, {P_SCORE} AS confidence FROM tried WHERE {P_SCORE} > 0.5e0),
normed AS (SELECT *, sqrt({" + ".join(f"{f} * {f}" for f in SCORE.weights)}) AS norm FROM candidates),
diverse AS (SELECT x.application_id, x.candidate_id, any_value(x.proximity) AS proximity, any_value(x.confidence) AS confidence,
    coalesce(1e0 - avg(({" + ".join(f"x.{f} * o.{f}" for f in SCORE.weights)}) / (x.norm * o.norm)), 1e0) AS diversity
  FROM normed x LEFT JOIN normed o ON x.application_id = o.application_id AND x.candidate_id <> o.candidate_id
  GROUP BY x.application_id, x.candidate_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY application_id ORDER BY score DESC, candidate_id) AS INT) AS position
  FROM (SELECT *, 0.5e0 * (1e0 / (1e0 + proximity)) + 0.3e0 * diversity + 0.2e0 * confidence AS score FROM diverse))"""

_E = EXPLAINED_SCORE.weights
CONTRIBUTIONS = (
    "means AS (SELECT "
    + ", ".join(f'avg(CAST("{f}" AS DOUBLE)) AS "m_{f}"' for f in _E)
    + " FROM applications), contributions AS ("
    + " UNION ALL ".join(
        f"""SELECT application_id, region, '{f}' AS feature, {number(w)} * (CAST("{f}" AS DOUBLE) - "m_{f}") AS contribution
  FROM applications, means"""
        for f, w in _E.items()
    )
    + ")"
)
IMPORTANCE = (
    CONTRIBUTIONS
    + ", importance AS (SELECT feature, avg(abs(contribution)) AS importance FROM contributions GROUP BY feature)"
)
CATEGORY = """CASE WHEN lower(feature) LIKE '%race%' OR lower(feature) LIKE '%gender%' OR lower(feature) LIKE '%age%' THEN 'demographic'
  WHEN lower(feature) LIKE '%income%' OR lower(feature) LIKE '%credit%' OR lower(feature) LIKE '%debt%' OR lower(feature) LIKE '%employment%' THEN 'financial'
  WHEN lower(feature) LIKE '%region%' OR lower(feature) LIKE '%zip%' OR lower(feature) LIKE '%urban%' THEN 'geographic'
  WHEN lower(feature) LIKE '%loan%' OR lower(feature) LIKE '%amount%' OR lower(feature) LIKE '%term%' OR lower(feature) LIKE '%interest%' THEN 'loan_specific'
  ELSE 'other' END"""


def local_effects() -> str:
    parts = []
    whole = linear(_E, EXPLAINED_SCORE.intercept)
    for f in _E:
        without = linear(_E, EXPLAINED_SCORE.intercept, {f: f'"m_{f}"'})
        parts.append(f"SELECT application_id, '{f}' AS feature, {whole} - {without} AS contribution FROM chosen, means")
    return " UNION ALL ".join(parts)


# --- monitoring ----------------------------------------------------------------------------------

WINDOWED = """
windowed AS (SELECT *, strftime(time_bucket(INTERVAL '30 days', application_date, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS window_start
  FROM applications)"""


def snapshot_ctes(source: str, segment: str, prefix: str) -> str:
    p = prefix
    ratios = "tp * 1e0 / nullif(tp + fp, 0)", "tp * 1e0 / nullif(tp + fn, 0)"
    shares = " UNION ALL ".join(
        f"""SELECT {segment} AS seg, 'share' AS family, '{a}' AS attribute, {a} AS key,
    count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY {segment}) AS value FROM {source} GROUP BY {segment}, {a}"""
        for a in ("race", "gender")
    )
    return f"""{metric_ctes(("race", "gender"), segment, "predicted", source, prefix=p)},
{p}confusion AS (SELECT {segment} AS seg, count(*) AS n, avg(approved) AS approval, avg(predicted) AS prediction,
    count(*) FILTER (WHERE approved = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE approved = 0 AND predicted = 1) AS fp,
    count(*) FILTER (WHERE approved = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE approved = 0 AND predicted = 0) AS tn
  FROM {source} GROUP BY 1),
{p}quality AS (SELECT *, (tp + tn) * 1e0 / n AS accuracy, coalesce({ratios[0]}, 0e0) AS prec, coalesce({ratios[1]}, 0e0) AS rec FROM {p}confusion),
{p}snapshots AS (
  SELECT seg, 'statistical' AS family, 'overall' AS attribute, 'approval_rate' AS key, approval AS value FROM {p}quality
  UNION ALL SELECT seg, 'statistical', 'overall', 'prediction_rate', prediction FROM {p}quality
  UNION ALL SELECT seg, 'sample', 'overall', 'sample_size', n * 1e0 FROM {p}quality
  UNION ALL SELECT seg, 'performance', 'overall', 'accuracy', accuracy FROM {p}quality
  UNION ALL SELECT seg, 'performance', 'overall', 'precision', prec FROM {p}quality
  UNION ALL SELECT seg, 'performance', 'overall', 'recall', rec FROM {p}quality
  UNION ALL SELECT seg, 'performance', 'overall', 'f1_score', 2 * prec * rec / (prec + rec) FROM {p}quality WHERE prec + rec > 0
  UNION ALL {shares}
  UNION ALL SELECT seg, 'fairness', attribute, metric, value FROM {p}metrics)"""


def classified(source: str) -> str:
    """Drift rows of ``source(seg, family, attribute, key, baseline, current)``."""
    return f"""SELECT seg, CASE WHEN family = 'fairness' THEN 'fairness_drift' ELSE 'statistical_drift' END AS type, attribute,
    CASE WHEN family = 'share' THEN 'demographic_proportion_' || attribute || '_' || key ELSE key END AS metric,
    baseline, current, abs(current - baseline) AS drift_amount,
    CASE WHEN key = 'approval_rate' THEN CASE WHEN abs(current - baseline) > 0.1e0 THEN 'high' ELSE 'medium' END
      ELSE CASE WHEN abs(current - baseline) > 0.15e0 THEN 'high' ELSE 'medium' END END AS severity
  FROM {source} WHERE (family = 'statistical' AND key = 'approval_rate' AND abs(current - baseline) > 0.05e0)
    OR (family IN ('share', 'fairness') AND abs(current - baseline) > 0.1e0)"""


SNAPSHOTS = f"{WINDOWED}, {snapshot_ctes('windowed', 'window_start', 'a_')}"
DRIFTS = f"""{SNAPSHOTS}, {snapshot_ctes("applications", "'all'", "b_")},
paired AS (SELECT c.seg, c.family, c.attribute, c.key, CASE WHEN c.family = 'fairness' THEN b.value ELSE coalesce(b.value, 0e0) END AS baseline,
    c.value AS current FROM a_snapshots c LEFT JOIN b_snapshots b USING (family, attribute, key)),
drifts AS ({classified("paired")}),
summary AS (SELECT seg, type, count(*) AS n_drifts, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS severity
  FROM drifts GROUP BY seg, type),
alerts AS (SELECT seg, 'DRIFT_DETECTED' AS type, severity, type || ' detected: '
    || CASE WHEN type = 'fairness_drift' THEN 'Fairness' ELSE 'Statistical' END || ' drift detected in ' || n_drifts || ' metrics' AS message,
    type AS drift FROM summary WHERE severity = 'high'),
latest AS (SELECT * FROM alerts WHERE CAST(seg AS DATE) > (SELECT max(CAST(seg AS DATE)) FROM alerts) - 365)"""
DRIFT_COLUMNS = (
    f"seg AS window_start, type, attribute, metric, {rnd('baseline', 'baseline')}, {rnd('current', 'current')}, "
    f"{rnd('drift_amount', 'drift_amount')}, severity"
)
EWMA = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY family, attribute, key ORDER BY seg) - 1 AS i FROM a_snapshots),
smooth AS (SELECT t.seg, t.family, t.attribute, t.key, any_value(t.value) AS value, any_value(t.i) AS i,
    sum(CASE WHEN x.i = 0 THEN power(0.9e0, t.i) * x.value ELSE 0.1e0 * power(0.9e0, t.i - x.i) * x.value END) AS baseline
  FROM numbered t JOIN numbered x ON t.family = x.family AND t.attribute = x.attribute AND t.key = x.key AND x.i <= t.i
  GROUP BY t.seg, t.family, t.attribute, t.key)"""
PREVIOUS = f"""{SNAPSHOTS}, {EWMA},
begin AS (SELECT min(seg) AS seg FROM a_snapshots),
previous AS (
  SELECT t.seg, t.family, t.attribute, t.key, p.baseline, t.value AS current FROM smooth t JOIN smooth p
    ON t.family = p.family AND t.attribute = p.attribute AND t.key = p.key AND p.i = t.i - 1 WHERE t.family <> 'share'
  UNION ALL SELECT t.seg, t.family, t.attribute, t.key, coalesce(p.value, 0e0), t.value FROM a_snapshots t
    LEFT JOIN a_snapshots p ON t.family = p.family AND t.attribute = p.attribute AND t.key = p.key AND p.seg = (SELECT seg FROM begin)
    WHERE t.family = 'share' AND t.seg > (SELECT seg FROM begin))"""
STREAMED = """SELECT window_start, strftime(CAST(window_start AS DATE) + INTERVAL '30 days', '%Y-%m-%d') AS window_end, race,
  count(*) AS n, CAST(sum(approved) AS BIGINT) AS approvals, CAST(sum(predicted) AS BIGINT) AS predicted_n FROM windowed"""
EVENTS = "timed AS (SELECT *, CASE WHEN value > 50 THEN 1 ELSE 0 END AS large FROM events)"


def joined(items: Sequence[str]) -> str:
    return ", ".join(f"'{i}'" for i in items)


def _rule(conditions: Sequence[tuple[str, str, float]]) -> str:
    return " AND ".join(f"{f} {op} {number(v)}" for f, op, v in conditions)


def oracle() -> dict[str, str]:
    simple = ("credit_score", "debt_to_income", "annual_income", "age")
    test_rows = f"{hashed('application_id', 42)} < {int(0.2 * HASH_MODULUS)}"
    q: dict[str, str] = {}
    q["load_table"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
    q["save_roundtrip"] = sql(
        f"""SELECT format, race, count(*) AS n, CAST(sum(approved) AS BIGINT) AS approvals, {rnd('avg(loan_amount)', 'avg_loan_amount')}
FROM applications, (VALUES ('csv'), ('json'), ('parquet')) f(format) GROUP BY format, race"""
    )
    q["versioned_overwrite"] = sql(
        """SELECT 'before' AS version, region, count(*) AS n, CAST(sum(approved) AS BIGINT) AS approvals FROM applications GROUP BY region
UNION ALL SELECT 'after', region, count(*), CAST(sum(approved) AS BIGINT) FROM applications WHERE region <> 'ASIA' OR approved = 1 GROUP BY region"""
    )
    q["sample_rows"] = sql(
        f"""SELECT application_id, race, credit_score, approved FROM applications
ORDER BY {hashed('application_id')}, application_id LIMIT 1000"""
    )
    q["sample_by_segment"] = sql(
        f"""SELECT application_id, region, approved, credit_score FROM applications
QUALIFY row_number() OVER (PARTITION BY region, approved ORDER BY {hashed('application_id')}, application_id) <= 200"""
    )
    six = ("race", "gender", "age_group", "region", "urban_rural", "loan_type")
    label = ", ".join(f"CASE WHEN GROUPING({a}) = 0 THEN '{a}=' || {a} END" for a in six)
    member = " + ".join(f"(1 - GROUPING({a}))" for a in six)
    chi = """CASE WHEN n = m OR t = 0 OR t = m THEN 0e0 ELSE CAST(m AS DOUBLE) * power(greatest(abs(CAST(a AS DOUBLE) * (m - n - t + a) - CAST(n - a AS DOUBLE) * (t - a)) - m / 2e0, 0e0), 2)
  / (CAST(n AS DOUBLE) * (m - n) * t * (m - t)) END"""
    q["subgroup_tests"] = sql(
        f"""SELECT subgroup, size, n, {rnd('rate', 'rate')}, {rnd('gap', 'gap')}, {rnd('p', 'p_value')}, {rnd('q', 'q_value')}, q <= 0.05e0 AS flagged
FROM (SELECT *, least(min(p * tests / place) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e0) AS q FROM ranked)""",
        f"""lattice AS (SELECT array_to_string(list_filter([{label}], lambda x: x IS NOT NULL), ' & ') AS subgroup, CAST({member} AS INT) AS size,
  count(*) AS n, CAST(sum(approved) AS BIGINT) AS a, (SELECT count(*) FROM applications) AS m, (SELECT CAST(sum(approved) AS BIGINT) FROM applications) AS t
  FROM applications GROUP BY CUBE ({", ".join(six)}) HAVING count(*) >= 100 AND {member} > 0),
tested AS (SELECT *, CAST(a AS DOUBLE) / n AS rate, CAST(a AS DOUBLE) / n - CAST(t AS DOUBLE) / m AS gap, {chi} AS chi FROM lattice),
judged AS (SELECT *, CASE WHEN chi <= 0 THEN 1e0 ELSE least({erfc('sqrt(chi / 2e0)')}, 1e0) END AS p FROM tested),
ranked AS (SELECT *, count(*) OVER () AS tests, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM judged)""",
    )
    q["export_metrics_flat"] = sql(
        f"""SELECT model, attribute AS protected_attribute, metric_name AS metric, {rnd('value', 'value')}, threshold, passed,
severity, regulation FROM both_models""",
        two_models(),
    )
    q["export_predictions"] = sql(
        f"""SELECT application_id, credit_score, {rnd('debt_to_income', 'debt_to_income')}, {rnd('annual_income', 'annual_income')}, age,
CASE WHEN p > 0.5e0 THEN 1 ELSE 0 END AS prediction, {rnd('p', 'prediction_probability')}, approved AS actual,
(CASE WHEN p > 0.5e0 THEN 1 ELSE 0 END) = approved AS correct FROM (SELECT *, {P_SCORE} AS p FROM applications)"""
    )
    q["age_band"] = sql(f"SELECT application_id, age, {AGE_BAND} AS band FROM applications")
    q["approval_score"] = sql(f"SELECT application_id, {rnd('predicted_probability', 'score')} FROM applications")
    q["bias_modifiers"] = sql(
        f"""SELECT application_id, {rnd('''predicted_probability * (CASE WHEN gender = 'F' THEN 0.85e0 ELSE 1e0 END)
  * (CASE WHEN race IN ('BUILDING', 'FURNITURE') THEN 0.75e0 ELSE 1e0 END)''', 'two_switches', 12)},
{rnd('approval_probability', 'all_switches', 12)} FROM applications"""
    )
    q["intersection_key"] = sql("SELECT application_id, race || '_' || gender || '_' || age AS intersection FROM flawed", FLAWED)
    flawed_columns = (
        "application_id race gender age annual_income credit_score employment_years debt_to_income loan_type "
        "loan_amount approved approved_amount"
    ).split()
    q["feature_categories"] = sql(
        f"SELECT feature, {CATEGORY} AS category, missing FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM flawed" for c in flawed_columns
        )
        + ")",
        FLAWED,
    )
    q["policy_rewrite"] = sql(
        f"""SELECT application_id, greatest(credit_score, 650) AS credit_score, {rnd('greatest(annual_income, 50000)', 'annual_income')},
CASE gender WHEN 'F' THEN 'O' ELSE gender END AS gender, {rnd('least(debt_to_income, 0.4e0)', 'debt_to_income')} FROM applications"""
    )
    deltas = f"SELECT application_id, feature, {rnd('before', 'before')}, {rnd('after', 'after')}, {rnd('delta', 'delta')} FROM ({POLICY_DELTAS})"
    q["significant_changes"] = q["policy_changes"] = sql(deltas)
    q["rate_cube"] = sql(
        " UNION ALL ".join(
            f"""SELECT region, '{a}' AS attribute, {a} AS grp, count(*) AS n, CAST(sum(approved) AS BIGINT) AS approvals,
count(*) FILTER (WHERE credit_score > 650) AS n_qual, count(*) FILTER (WHERE credit_score > 650 AND approved = 1) AS appr_qual,
count(*) FILTER (WHERE credit_score <= 650) AS n_unqual, count(*) FILTER (WHERE credit_score <= 650 AND approved = 1) AS appr_unqual,
count(*) FILTER (WHERE predicted_probability > 0.5e0) AS n_pred,
count(*) FILTER (WHERE predicted_probability > 0.5e0 AND approved = 1) AS appr_pred FROM applications GROUP BY region, {a}"""
            for a in AUDITED
        )
    )
    q["group_rates_ci"] = sql(
        f"""SELECT attribute, grp, n, CAST(y AS BIGINT) AS approvals, {rnd('rate', 'rate')},
{rnd('rate - 1.96e0 * sqrt(rate * (1 - rate) / n)', 'ci_low')}, {rnd('rate + 1.96e0 * sqrt(rate * (1 - rate) / n)', 'ci_high')} FROM groups""",
        metric_ctes(PROTECTED),
    )
    q["disparate_impact"] = single_metric("four_fifths_rule")
    q["demographic_parity"] = single_metric("demographic_parity", REFERENCES)
    q["equal_opportunity"] = single_metric("equal_opportunity", REFERENCES)
    q["predictive_parity"] = single_metric("predictive_parity")
    q["equalized_odds"] = single_metric("equalized_odds")
    by_region = metric_ctes(AUDITED, segment="region")
    q["chi_square_pair"] = sql(
        f"""SELECT m.seg AS region, m.attribute, reference_group, impacted_group, {rnd('coalesce(chi, 0e0)', 'chi_square')},
{rnd('p_value', 'p_value')} FROM metrics m LEFT JOIN chi c ON m.seg = c.seg AND m.attribute = c.attribute WHERE metric = 'four_fifths_rule'""",
        by_region,
    )
    q["all_metrics"] = sql(f"SELECT seg AS region, {METRIC_COLUMNS} FROM metrics", by_region)
    q["intersectional_metrics"] = sql(
        f"SELECT {METRIC_COLUMNS} FROM metrics",
        metric_ctes({"intersectional_group": "race || '_' || gender || '_' || age_group"}),
    )
    q["quick_impact"] = sql(
        f"""SELECT attribute, {rnd('min(rate) / max(rate)', 'impact_ratio')}, min(rate) / max(rate) < 0.8e0 AS has_disparate_impact
FROM groups GROUP BY attribute""",
        metric_ctes(PROTECTED),
    )
    q["intersection_impact"] = sql(
        f"""SELECT r.race, z.zip_code, g.region, {rnd('t.rate / o.rate', 'impact_ratio')}, coalesce(t.rate / o.rate < 0.8e0, FALSE) AS has_disparate_impact
FROM (SELECT DISTINCT race FROM applications) r CROSS JOIN (SELECT DISTINCT zip_code FROM applications) z
CROSS JOIN (SELECT DISTINCT region FROM applications) g CROSS JOIN (SELECT avg(approved) AS rate FROM applications) o
LEFT JOIN (SELECT race, zip_code, region, avg(approved) AS rate FROM applications GROUP BY ALL) t
  ON t.race = r.race AND t.zip_code = z.zip_code AND t.region = g.region"""
    )
    q["redlining"] = sql(
        f"""SELECT tract, n, approvals, {rnd('rate', 'rate')} FROM rates
WHERE rate < (SELECT avg(rate) - 2 * stddev_samp(rate) FROM rates)""",
        """places AS (SELECT n_name || '/' || kind AS tract FROM nation JOIN region ON n_regionkey = r_regionkey,
  (VALUES ('Urban'), ('Suburban'), ('Rural')) k(kind) WHERE r_name <> 'EUROPE')""",
        """rates AS (SELECT tract, count(*) AS n, CAST(sum(approved) AS BIGINT) AS approvals, avg(approved) AS rate
  FROM applications JOIN places USING (tract) GROUP BY tract)""",
    )
    sets = "(), (race), (gender), (age_group), (race, gender), (race, age_group), (gender, age_group)"
    q["grouped_cube"] = sql(
        f"""SELECT CASE WHEN race IS NULL AND gender IS NULL AND age_group IS NULL THEN 'overall' ELSE concat_ws('*',
CASE WHEN race IS NOT NULL THEN 'race' END, CASE WHEN gender IS NOT NULL THEN 'gender' END,
CASE WHEN age_group IS NOT NULL THEN 'age_group' END) END AS level, race, gender, age_group, count(*) AS n,
CAST(sum(approved) AS BIGINT) AS approvals, {rnd('avg(approved)', 'rate')} FROM applications GROUP BY GROUPING SETS ({sets})"""
    )
    q["portfolio_kpis"] = sql(
        f"""SELECT count(*) AS applications, {rnd('avg(approved)', 'approval_rate')}, {rnd('avg(loan_amount)', 'avg_loan_amount')},
{rnd('avg(credit_score)', 'avg_credit_score')} FROM applications"""
    )
    q["region_summary"] = sql(
        f"""SELECT region, {rnd('avg(approved)', 'approval_rate')}, count(application_id) AS applications, {rnd('avg(annual_income)', 'avg_income')}
FROM applications GROUP BY region"""
    )
    q["approval_by_group"] = sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS attribute, {a} AS grp, {rnd('avg(approved)', 'approval_rate')} FROM applications GROUP BY {a}"
            for a in ("gender", "race", "region")
        )
    )
    q["value_shares"] = sql(
        " UNION ALL ".join(
            f"""SELECT '{a}' AS attribute, {a} AS grp, count(*) AS n, {rnd('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', 'share')}
FROM flawed WHERE {a} IS NOT NULL GROUP BY {a}"""
            for a in ("race", "gender", "loan_type")
        ),
        FLAWED,
    )
    q["numeric_profile"] = sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, {rnd(f'avg({c})', 'mean')}, {rnd(f'median(CAST({c} AS DOUBLE))', 'median')},
{rnd(f'stddev_samp({c})', 'std')} FROM flawed"""
            for c in ("age", "annual_income", "credit_score", "employment_years", "debt_to_income")
        ),
        FLAWED,
    )
    q["correlations"] = sql(
        " UNION ALL ".join(
            f"SELECT '{x}' AS x, '{y}' AS y, {rnd(f'corr({x}, {y})', 'correlation')} FROM applications"
            for x, y in (("annual_income", "credit_score"), ("age", "employment_years"))
        )
    )
    q["range_checks"] = sql(
        """SELECT 'age' AS "column", count(*) FILTER (WHERE age < 18 OR age > 100) AS violations FROM flawed
UNION ALL SELECT 'credit_score', count(*) FILTER (WHERE credit_score < 300 OR credit_score > 850) FROM flawed
UNION ALL SELECT 'debt_to_income', count(*) FILTER (WHERE debt_to_income < 0 OR debt_to_income > 2) FROM flawed""",
        FLAWED,
    )
    q["domain_checks"] = sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS "rows" FROM flawed
WHERE {c} IS NULL OR {c} NOT IN ({joined(accepted)}) GROUP BY {c}"""
            for c, accepted in CHECK_DOMAINS.items()
        ),
        FLAWED,
    )
    rules = """SELECT 'approved_amount_exceeds_loan' AS rule, 'error' AS level, count(*) FILTER (WHERE approved_amount > loan_amount) AS violations FROM flawed
UNION ALL SELECT 'approved_without_amount', 'warning', count(*) FILTER (WHERE approved = 1 AND approved_amount <= 0) FROM flawed
UNION ALL SELECT 'implausible_employment', 'warning', count(*) FILTER (WHERE employment_years > age - 16) FROM flawed"""
    q["business_rules"] = sql(rules, FLAWED)
    q["quality_summary"] = sql(
        """SELECT count(*) AS total_rows, 12 AS total_columns, count(*) FILTER (WHERE race IS NULL) + count(*) FILTER (WHERE age IS NULL)
  + count(*) FILTER (WHERE employment_years IS NULL) AS missing_values,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM flawed)) AS duplicate_rows FROM flawed""",
        FLAWED,
    )
    unexpected = " UNION ALL ".join(
        f"""SELECT 'domain' AS "check", '{c}' AS "column", count(DISTINCT coalesce({c}, '<null>')) AS violations, 'warning' AS level FROM flawed
WHERE {c} IS NULL OR {c} NOT IN ({joined(accepted)})"""
        for c, accepted in CHECK_DOMAINS.items()
    )
    q["quality_findings"] = sql(
        f"""SELECT *, FALSE AS is_valid FROM (
SELECT 'range' AS "check", 'credit_score' AS "column", count(*) FILTER (WHERE credit_score < 300 OR credit_score > 850) AS violations, 'warning' AS level FROM flawed
UNION ALL {unexpected}
UNION ALL SELECT 'business_rule', 'approved_amount_exceeds_loan', count(*) FILTER (WHERE approved_amount > loan_amount), 'error' FROM flawed
UNION ALL SELECT 'business_rule', 'implausible_employment', count(*) FILTER (WHERE employment_years > age - 16), 'warning' FROM flawed
UNION ALL SELECT 'missing_values', NULL, count(*) FILTER (WHERE race IS NULL) + count(*) FILTER (WHERE age IS NULL)
  + count(*) FILTER (WHERE employment_years IS NULL), 'recommendation' FROM flawed
UNION ALL SELECT 'duplicate_rows', NULL, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (approved) FROM flawed)), 'recommendation' FROM flawed
UNION ALL SELECT 'missing_column', 'approved', 1, 'error'
UNION ALL SELECT 'not_numeric', 'age', 1, 'warning') WHERE violations > 0""",
        FLAWED,
    )
    q["risk_score"] = assessed(
        f"""SELECT seg AS tract, attribute, {rnd('score', 'overall_risk_score')}, severity, color, n_violations = 0 AS compliant,
scores AS metric_scores, regulations AS violations FROM assessed"""
    )
    q["worst_case_risk"] = assessed(
        f"""SELECT seg AS tract, attribute, {rnd('score', 'overall_risk_score')} FROM (SELECT *, row_number() OVER (
PARTITION BY seg ORDER BY score DESC, attribute) AS k FROM assessed) WHERE k = 1"""
    )
    q["compliance"] = assessed(
        """SELECT seg AS tract, attribute, NOT contains(regulations, 'ECOA') AS ecoa_ok, NOT contains(regulations, 'Fair Housing') AS fha_ok,
TRUE AS state_ok, n_violations = 0 AS compliant, violations FROM assessed"""
    )
    q["triggered_rules"] = assessed("SELECT seg AS tract, attribute, ordinal, code, grp FROM rules")
    q["portfolio_alerts"] = assessed(
        """SELECT seg AS tract, attribute, type, priority, message, TRUE AS action_required, coalesce(details, '') AS details FROM (
SELECT a.seg, a.attribute, 'HIGH_RISK' AS type, 'CRITICAL' AS priority, printf('High bias risk detected (score: %.2f)', score) AS message, three AS details
  FROM assessed a LEFT JOIN recommended r ON a.seg = r.seg AND a.attribute = r.attribute WHERE score >= 0.7e0
UNION ALL SELECT a.seg, a.attribute, 'MEDIUM_RISK', 'HIGH', printf('Medium bias risk detected (score: %.2f)', score), two
  FROM assessed a LEFT JOIN recommended r ON a.seg = r.seg AND a.attribute = r.attribute WHERE score >= 0.4e0 AND score < 0.7e0
UNION ALL SELECT seg, attribute, 'COMPLIANCE_VIOLATION', 'CRITICAL', 'Regulatory compliance violations detected: ' || n_violations || ' issues', violations
  FROM assessed WHERE n_violations > 0
UNION ALL SELECT seg, attribute, 'METRIC_FAILURE', 'HIGH', 'Multiple fairness metrics failing: ' || n_risky || ' metrics', risky FROM assessed WHERE n_risky > 0)"""
    )
    q["high_risk_metrics"] = sql(
        """SELECT seg AS tract, attribute, coalesce(string_agg(CASE WHEN severity = 'High' THEN metric END, ',' ORDER BY metric), '') AS high_risk_metrics,
CASE WHEN bool_or(severity = 'High') THEN 'High' ELSE 'Low' END AS bias_severity FROM metrics GROUP BY seg, attribute""",
        metric_ctes(AUDITED, segment="tract"),
    )
    q["performance"] = sql(
        f"""SELECT region, {rnd('accuracy', 'accuracy')}, {rnd('p', '"precision"')}, {rnd('r', 'recall')}, {rnd('2 * p * r / nullif(p + r, 0)', 'f1_score')}
FROM (SELECT region, avg(CASE WHEN approved = predicted THEN 1e0 ELSE 0e0 END) AS accuracy,
  coalesce(avg(CASE WHEN predicted = 1 THEN approved END), 0e0) AS p, coalesce(avg(CASE WHEN approved = 1 THEN predicted END), 0e0) AS r
  FROM applications GROUP BY region)"""
    )
    q["auc"] = sql(
        f"""SELECT {rnd('(sum(CASE WHEN approved = 1 THEN rnk END) - sum(approved) * (sum(approved) + 1) / 2e0) / (sum(approved) * CAST(sum(1 - approved) AS DOUBLE))', 'area_under_roc')}
FROM (SELECT approved, rank() OVER (ORDER BY predicted_probability) + (count(*) OVER (PARTITION BY predicted_probability) - 1) / 2e0 AS rnk FROM applications)"""
    )
    q["auc_by_segment"] = sql(
        " UNION ALL ".join(
            f"""SELECT '{level}' AS level, segment, count(*) AS n, CAST(sum(approved) AS BIGINT) AS positives,
{rnd('(sum(CASE WHEN approved = 1 THEN rnk END) - sum(approved) * (sum(approved) + 1) / 2e0) / nullif(sum(approved) * CAST(sum(1 - approved) AS DOUBLE), 0)', 'area_under_roc')}
FROM (SELECT {level} AS segment, approved, rank() OVER (PARTITION BY {level} ORDER BY predicted_probability)
  + (count(*) OVER (PARTITION BY {level}, predicted_probability) - 1) / 2e0 AS rnk FROM applications) GROUP BY segment"""
            for level in ("region", "tract")
        )
    )
    sketched = " UNION ALL ".join(
        f"SELECT {segment} AS segment, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM windowed"
        for segment in ("window_start", "region", "'all'")
        for c in ("age", "annual_income", "loan_amount")
    )
    q["segment_profile"] = sql(
        f"""SELECT segment, feature, n, {rnd('mean', 'mean')}, {rnd('std', 'std')}, share, {rnd('low', 'low')}, {rnd('high', 'high')}, {rnd('(low + high) / 2e0', 'estimate')}
FROM (SELECT r.segment, r.feature, any_value(r.n) AS n, any_value(mean) AS mean, any_value(std) AS std, share,
    max(CASE WHEN i = floor((r.n - 1) * share) THEN low END) + any_value((r.n - 1) * share - floor((r.n - 1) * share))
      * (max(CASE WHEN i = ceil((r.n - 1) * share) THEN low END) - max(CASE WHEN i = floor((r.n - 1) * share) THEN low END)) AS low,
    max(CASE WHEN i = floor((r.n - 1) * share) THEN high END) + any_value((r.n - 1) * share - floor((r.n - 1) * share))
      * (max(CASE WHEN i = ceil((r.n - 1) * share) THEN high END) - max(CASE WHEN i = floor((r.n - 1) * share) THEN high END)) AS high
  FROM ranked r JOIN moments m ON m.segment = r.segment AND m.feature = r.feature, (VALUES (0.25e0), (0.5e0), (0.75e0)) AS shares(share)
  GROUP BY r.segment, r.feature, share)""",
        WINDOWED,
        f"""sketched AS ({sketched}),
moments AS (SELECT segment, feature, avg(x) AS mean, stddev_samp(x) AS std FROM sketched GROUP BY segment, feature),
binned AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE sign(x) * (ceil(ln(abs(x)) / ln(1.02e0)) + 40000) END AS bin FROM sketched),
ranked AS (SELECT segment, feature, min(x) OVER b AS low, max(x) OVER b AS high, count(*) OVER (PARTITION BY segment, feature) AS n,
    row_number() OVER (PARTITION BY segment, feature ORDER BY x) - 1 AS i
  FROM binned WINDOW b AS (PARTITION BY segment, feature, bin))""",
    )
    priced = "SELECT '{a}' AS attribute, {a} AS grp, count(*) AS n, avg(approved_interest_rate) AS avg_rate FROM applications WHERE approved = 1 GROUP BY {a}"
    q["pricing_gap"] = sql(
        f"""SELECT attribute, grp, n, {rnd('avg_rate', 'avg_rate')}, {rnd('avg_rate - min(avg_rate) OVER ()', 'gap')} FROM ({priced.format(a='race')})
UNION ALL SELECT attribute, grp, n, {rnd('avg_rate', 'avg_rate')}, {rnd("avg_rate - max(CASE WHEN grp = 'O' THEN avg_rate END) OVER ()", 'gap')}
FROM ({priced.format(a='gender')})"""
    )
    q["group_ranking"] = sql(
        f"""SELECT attribute, grp, {rnd('rate', 'rate')}, CAST(row_number() OVER w AS INT) AS position, first_value(grp) OVER w AS best_group,
first_value(grp) OVER (PARTITION BY attribute ORDER BY rate, grp) AS worst_group, {rnd('max(rate) OVER (PARTITION BY attribute) - rate', 'gap_to_best')}
FROM groups WINDOW w AS (PARTITION BY attribute ORDER BY rate DESC, grp)""",
        metric_ctes(PROTECTED),
    )
    q["top_features"] = sql(
        f"SELECT feature, {rnd('importance', 'importance')} FROM importance ORDER BY importance.importance DESC, feature LIMIT 5", IMPORTANCE
    )
    q["redlining_hotspots"] = assessed(
        f"""SELECT seg AS tract, {rnd('max(score)', 'risk_score')}, (SELECT count(*) FROM (SELECT seg FROM assessed GROUP BY seg HAVING max(score) > 0.7e0)) AS n_hotspots
FROM assessed GROUP BY seg HAVING max(score) > 0.7e0 ORDER BY max(score) DESC, seg LIMIT 5"""
    )
    pairs = [(a, b) for i, a in enumerate(PROTECTED) for b in PROTECTED[i + 1 :]]
    q["worst_intersection"] = sql(
        f"SELECT level, {rnd('disparity', 'disparity')} FROM (SELECT level, max(rate) - min(rate) AS disparity FROM ("
        + " UNION ALL ".join(
            f"SELECT '{a}*{b}' AS level, avg(approved) AS rate FROM applications GROUP BY {a}, {b}" for a, b in pairs
        )
        + ") GROUP BY level) t WHERE t.disparity >= 0.2e0 ORDER BY t.disparity DESC, level LIMIT 1"
    )
    q["union_metrics"] = sql(
        f"SELECT model, attribute, metric, {rnd('value', 'value')}, passed, severity FROM both_models", two_models()
    )
    q["distinct_groups"] = sql(
        " UNION ALL ".join(
            f"SELECT DISTINCT '{a}' AS attribute, {a} AS grp FROM flawed WHERE {a} IS NOT NULL" for a in ("race", "gender", "loan_type")
        ),
        FLAWED,
    )
    q["impute"] = sql(
        f"""SELECT application_id, {rnd('coalesce(CAST(age AS DOUBLE), m.age_median)', 'age')}, {rnd('CAST(credit_score AS DOUBLE)', 'credit_score')},
coalesce(race, (SELECT race FROM train WHERE race IS NOT NULL GROUP BY race ORDER BY count(*) DESC, race LIMIT 1)) AS race
FROM flawed, (SELECT median(CAST(age AS DOUBLE)) AS age_median FROM train) m""",
        FLAWED,
        f"train AS (SELECT * FROM flawed WHERE NOT {test_rows})",
    )
    one_hot = [("gender", g) for g in ("F", "O", "P")] + [
        ("loan_type", t) for t in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
    ]
    q["one_hot"] = sql(
        "SELECT application_id, "
        + ", ".join(
            f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {c}_{v.lower().replace('-', '_').replace(' ', '_')}" for c, v in one_hot
        )
        + " FROM applications"
    )
    moments = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in simple)
    q["standardise"] = sql(
        f"SELECT application_id, {', '.join(rnd(f'({c} - m_{c}) / s_{c}', c) for c in simple)}, 0e0 AS constant "
        f"FROM applications, (SELECT {moments} FROM applications WHERE NOT {test_rows}) WHERE {test_rows}"
    )
    races = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    q["prepare"] = sql(
        f"""SELECT application_id, approved, {rnd('(age - avg(age) OVER ()) / stddev_pop(age) OVER ()', 'age')},
{rnd('(credit_score - avg(credit_score) OVER ()) / stddev_pop(credit_score) OVER ()', 'credit_score')},
{", ".join(f"CASE WHEN race = '{r}' THEN 1 ELSE 0 END AS race_{r}" for r in races)} FROM filled""",
        FLAWED,
        """filled AS (SELECT application_id, approved, coalesce(CAST(age AS DOUBLE), (SELECT median(CAST(age AS DOUBLE)) FROM flawed)) AS age,
  CAST(credit_score AS DOUBLE) AS credit_score, coalesce(race, (SELECT race FROM flawed WHERE race IS NOT NULL GROUP BY race
    ORDER BY count(*) DESC, race LIMIT 1)) AS race FROM flawed)""",
    )
    q["split"] = sql(
        f"SELECT application_id, approved, CASE WHEN {test_rows} THEN 'test' ELSE 'train' END AS part FROM applications"
    )
    limits = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in simple)
    q["min_max"] = sql(
        "SELECT application_id, "
        + ", ".join(
            rnd(f"least(greatest(({c} - lo_{c}) / CAST(hi_{c} - lo_{c} AS DOUBLE), 0e0), 1e0)", c) for c in simple
        )
        + f", 0e0 AS constant FROM applications, (SELECT {limits} FROM applications WHERE NOT {test_rows})"
    )
    q["fairness_improvement"] = sql(
        f"""SELECT attribute, metric, {rnd('b.value', 'baseline')}, {rnd('m.value', 'mitigated')}, {rnd('b.value - m.value', 'improvement')},
{rnd('CASE WHEN b.value <> 0 THEN (b.value - m.value) / b.value * 100 ELSE 0e0 END', 'percent_improvement')},
b.passed AS passed_baseline, m.passed AS passed_mitigated FROM a_metrics b JOIN b_metrics m USING (attribute, metric)""",
        two_models(),
    )
    q["linear_score"] = sql(
        f"SELECT application_id, {rnd('p', 'probability')}, CASE WHEN p > 0.5e0 THEN 1 ELSE 0 END AS flag FROM (SELECT *, {P_SCORE} AS p FROM applications)"
    )
    q["rule_support"] = sql(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS rule, count(*) AS samples, CASE WHEN avg(approved) > 0.5e0 THEN 'Approved' ELSE 'Rejected' END AS prediction,
{rnd('greatest(avg(approved), 1 - avg(approved))', 'confidence')} FROM applications WHERE {_rule(conditions)}"""
            for name, conditions in RULES.items()
        )
    )
    q["policy_impact"] = sql(
        f"SELECT {CHANGE}, count(*) FILTER (WHERE baseline <> modified) AS affected_applications FROM decisions", DECISIONS
    )
    q["policy_impact_by_group"] = sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS attribute, {a} AS grp, {CHANGE} FROM decisions GROUP BY {a}" for a in PROTECTED
        ),
        DECISIONS,
    )
    swept = " UNION ALL ".join(
        f"""SELECT '{a}' AS attribute, {a} AS grp, cutoff, count(*) AS n, avg(CASE WHEN predicted_probability > cutoff THEN 1e0 ELSE 0e0 END) AS rate
FROM applications, cutoffs GROUP BY {a}, cutoff"""
        for a in AUDITED
    )
    q["threshold_sweep"] = sql(
        f"""SELECT attribute, grp, n, cutoff, {rnd('rate', 'approval_rate')}, {rnd('''coalesce(min(rate) OVER (PARTITION BY attribute, cutoff)
  / nullif(max(rate) OVER (PARTITION BY attribute, cutoff), 0), 0e0)''', 'impact_ratio')} FROM ({swept})""",
        f"cutoffs(cutoff) AS (VALUES {', '.join(f'({number(c)})' for c in CUTOFFS)})",
    )
    q["counterfactual_grid"] = sql(
        f"""SELECT application_id, candidate_id, {", ".join(rnd(f, f, 4) for f in SCORE.weights)}, {rnd('confidence', 'confidence', 4)},
{rnd('proximity', 'proximity', 4)} FROM candidates""",
        CANDIDATES,
    )
    q["counterfactual_rank"] = sql(
        f"SELECT application_id, candidate_id, position, {rnd('score', 'score')} FROM ranked WHERE position <= 5", CANDIDATES
    )
    q["diversity"] = sql(f"SELECT application_id, candidate_id, {rnd('diversity', 'diversity')} FROM diverse", CANDIDATES)
    q["reweigh"] = sql(
        f"""SELECT application_id, race, approved, {rnd('''(count(*) OVER (PARTITION BY race)) * CAST(count(*) OVER (PARTITION BY approved) AS DOUBLE)
  / (count(*) OVER ()) / (count(*) OVER (PARTITION BY race, approved))''', 'weight')} FROM applications"""
    )
    q["linear_attribution"] = sql(
        f"SELECT application_id, feature, {rnd('contribution', 'contribution')} FROM contributions", CONTRIBUTIONS
    )
    q["global_importance"] = sql(
        f"""SELECT CAST(row_number() OVER (ORDER BY importance.importance DESC, feature) AS INT) AS position, feature,
{rnd('importance.importance', 'importance')} FROM importance""",
        IMPORTANCE,
    )
    q["protected_contribution"] = sql(
        f"""SELECT p AS attribute, {rnd('sum(i.importance)', 'importance')}, {rnd('sum(i.importance) / (SELECT sum(importance) FROM importance)', 'share')}
FROM importance i JOIN (VALUES ('race'), ('gender'), ('age')) x(p) ON starts_with(feature, p) GROUP BY p""",
        IMPORTANCE,
    )
    q["local_attribution"] = sql(
        f"""SELECT application_id, CAST(position AS INT) AS position, feature, {rnd('contribution', 'contribution')} FROM (
SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY abs(contribution) DESC, feature) AS position FROM effects) WHERE position <= 5""",
        CONTRIBUTIONS,
        f"chosen AS (SELECT * FROM applications ORDER BY {hashed('application_id')}, application_id LIMIT 100)",
        f"effects AS ({local_effects()})",
    )
    q["attribution_stability"] = sql(
        f"""SELECT feature, {rnd('m', 'mean')}, {rnd('s', 'std')}, {rnd('lo', '"min"')}, {rnd('hi', '"max"')}, appearances,
{rnd('(SELECT 1e0 / (1e0 + avg(power(s, 2)) FILTER (WHERE appearances > 0) / avg(abs(m))) FROM spread)', 'stability_score')} FROM spread""",
        CONTRIBUTIONS,
        """runs AS (SELECT region AS run, feature, value FROM (SELECT region, feature, avg(abs(contribution_by_region)) AS value,
    row_number() OVER (PARTITION BY region ORDER BY avg(abs(contribution_by_region)) DESC, feature) AS k
  FROM (SELECT region, feature, contribution AS contribution_by_region FROM contributions) GROUP BY region, feature) WHERE k <= 5)""",
        """spread AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi, count(*) FILTER (WHERE x <> 0) AS appearances
  FROM (SELECT f.feature, r.run, coalesce(runs.value, 0e0) AS x FROM (SELECT DISTINCT feature FROM runs) f CROSS JOIN (SELECT DISTINCT run FROM runs) r
    LEFT JOIN runs ON runs.feature = f.feature AND runs.run = r.run) GROUP BY feature)""",
    )
    q["importance_by_category"] = sql(
        f"SELECT {CATEGORY} AS category, count(*) AS features, {rnd('sum(importance.importance)', 'importance')} FROM importance GROUP BY 1", IMPORTANCE
    )
    q["window_snapshots"] = sql(
        f"SELECT seg AS window_start, family, attribute, key, {rnd('value', 'value')} FROM a_snapshots", SNAPSHOTS
    )
    q["statistical_drift"] = sql(f"SELECT {DRIFT_COLUMNS} FROM drifts WHERE type = 'statistical_drift'", DRIFTS)
    q["fairness_drift"] = sql(f"SELECT {DRIFT_COLUMNS} FROM drifts WHERE type = 'fairness_drift'", DRIFTS)
    q["drift_summary"] = sql("SELECT seg AS window_start, type, n_drifts, severity FROM summary", DRIFTS)
    q["drift_alerts"] = sql("SELECT seg AS window_start, type, severity, message, drift FROM alerts", DRIFTS)
    q["monitoring_report"] = sql(
        """SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity = 'critical') AS critical_alerts, count(*) AS drifts_detected,
CAST(0 AS BIGINT) AS performance_issues FROM latest""",
        DRIFTS,
    )
    q["alert_counts"] = sql("SELECT type, severity, count(*) AS alerts FROM latest GROUP BY type, severity", DRIFTS)
    q["ewma_baseline"] = sql(
        f"""SELECT seg AS window_start, family, attribute, key, {rnd('value', 'value')}, {rnd('baseline', 'baseline')} FROM smooth
WHERE family <> 'fairness'""",
        SNAPSHOTS,
        EWMA,
    )
    q["drift_vs_previous"] = sql(
        f"SELECT {DRIFT_COLUMNS} FROM ({classified('previous')})", PREVIOUS
    )
    passed = "CAST(seg AS DATE) <= (SELECT max(CAST(seg AS DATE)) FROM a_snapshots) - INTERVAL '60 days'"
    q["ewma_stream"] = sql(
        f"""SELECT seg AS window_start, family, attribute, key, {rnd('value', 'value')}, {rnd('baseline', 'baseline')} FROM smooth
WHERE family <> 'fairness' AND {passed}""",
        SNAPSHOTS,
        EWMA,
    )
    q["stream_drift"] = sql(f"SELECT {DRIFT_COLUMNS} FROM ({classified('previous')}) WHERE {passed}", PREVIOUS)
    grouped = "GROUP BY window_start, race"
    q["stream_snapshots"] = sql(
        f"""{STREAMED} WHERE CAST(window_start AS TIMESTAMP) + INTERVAL '30 days' <= (SELECT max(application_date) FROM applications) - INTERVAL '60 days'
{grouped}""",
        WINDOWED,
    )
    q["stream_snapshots_complete"] = sql(f"{STREAMED} {grouped}", WINDOWED)
    q["late_events"] = f"""WITH {EVENTS}, arrivals AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN 2 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS batch,
  date_trunc('day', ts) AS w FROM timed)
SELECT strftime(w, '%Y-%m-%d') AS window_start, strftime(w + INTERVAL '1 day', '%Y-%m-%d') AS window_end, event_type,
  count(*) AS n, CAST(sum(large) AS BIGINT) AS large_n FROM arrivals
WHERE (batch <> 1 OR w + INTERVAL '1 day' > (SELECT max(ts) FROM arrivals WHERE batch = 0) - INTERVAL '2 days')
  AND w + INTERVAL '1 day' <= (SELECT max(ts) FROM arrivals) - INTERVAL '2 days' GROUP BY w, event_type"""
    q["late_accounts"] = f"""WITH {EVENTS}, arrivals AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN 2 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS batch,
  date_trunc('day', ts) AS w FROM timed),
marks AS (SELECT b AS batch, (SELECT max(ts) FROM arrivals WHERE batch < b) - INTERVAL '2 days' AS mark FROM range(3) t(b))
SELECT strftime(w, '%Y-%m-%d') AS window_start, event_type,
  CASE WHEN mark IS NULL OR ts >= mark THEN 'on_time' WHEN w + INTERVAL '1 day' > mark THEN 'late' ELSE 'dropped' END AS status,
  count(*) AS n, CAST(sum(large) AS BIGINT) AS large_n FROM arrivals a JOIN marks m ON m.batch = a.batch GROUP BY ALL"""
    q["sliding_counts"] = f"""WITH {EVENTS}, slid AS (SELECT *, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS w FROM timed, range(2) t(k))
SELECT strftime(w, '%Y-%m-%d') AS window_start, strftime(w + INTERVAL '2 days', '%Y-%m-%d') AS window_end, event_type,
  count(*) AS n, CAST(sum(large) AS BIGINT) AS large_n FROM slid GROUP BY w, event_type"""
    q["session_counts"] = f"""WITH {EVENTS}, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '12 hours'
  THEN 0 ELSE 1 END AS starts FROM timed), numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(max(ts) + INTERVAL '12 hours', '%Y-%m-%d %H:%M:%S') AS window_end, user_id,
  count(*) AS n, CAST(sum(large) AS BIGINT) AS large_n FROM numbered GROUP BY user_id, session"""
    return q
