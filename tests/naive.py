"""Row-at-a-time fairness metrics, straight from the definitions."""

import math
from collections import defaultdict


def mean(values):
    return sum(values) / len(values) if values else None


def fairness(rows, attribute, reference=None, outcome="approved", has_probability=True):
    """rows: dicts with attribute, outcome, credit_score, predicted_probability."""
    groups = defaultdict(list)
    for r in rows:
        if r[attribute] is not None and r[outcome] is not None:
            groups[r[attribute]].append(r)
    names = sorted(groups)
    rate = {g: mean([r[outcome] for r in groups[g]]) for g in names}
    best = min(names, key=lambda g: (-rate[g], g))
    ref = reference if reference in groups else best
    ratios = {g: rate[g] / rate[ref] for g in names if g != ref and rate[ref] > 0}
    worst = min(ratios, key=lambda g: (ratios[g], g)) if ratios else None
    result = {"four_fifths_rule": (min(ratios.values()) if ratios else 1.0, ref, worst)}
    result["p_value"] = chi_square_p(rows, attribute, (ref, worst), outcome) if worst is not None else 1.0
    gaps = {g: abs(rate[g] - rate[ref]) for g in names if g != ref}
    result["demographic_parity"] = (*largest(gaps), ref)

    def qualified(g, good):
        return [
            r[outcome]
            for r in groups[g]
            if r["credit_score"] is not None and (r["credit_score"] > 650) == good
        ]

    tprs = {g: mean(qualified(g, True)) for g in names if qualified(g, True)}
    if tprs:
        qref = reference if reference is not None else min(tprs, key=lambda g: (-tprs[g], g))
        at = tprs.get(qref, 0.0)
        result["equal_opportunity"] = (*largest({g: abs(t - at) for g, t in tprs.items() if g != qref}), qref)
    else:
        result["equal_opportunity"] = (0.0, None, None)
    if has_probability:
        precision = [
            mean([r[outcome] for r in groups[g] if (r["predicted_probability"] or 0) > 0.5])
            for g in names
        ]
        precision = [p for p in precision if p is not None]
        result["predictive_parity"] = max(precision) - min(precision) if precision else 0.0
    tpr = [mean(qualified(g, True)) or 0.0 for g in names]
    fpr = [mean(qualified(g, False)) or 0.0 for g in names]
    result["equalized_odds"] = (max(tpr) - min(tpr) + max(fpr) - min(fpr)) / 2
    return result


def largest(gaps):
    positive = {g: d for g, d in gaps.items() if d > 0}
    if not positive:
        return 0.0, None
    g = min(positive, key=lambda x: (-positive[x], x))
    return positive[g], g


def chi_square_p(rows, attribute, pair, outcome):
    table = [[0, 0], [0, 0]]
    for r in rows:
        if r[attribute] is not None and r[outcome] is not None:
            table[r[attribute] in pair][r[outcome]] += 1
    (a, b), (c, d) = table
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    if margins == 0:
        return 1.0
    chi = n * max(abs(a * d - b * c) - n / 2, 0) ** 2 / margins
    return math.erfc(math.sqrt(chi / 2))
