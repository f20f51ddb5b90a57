"""DuckDB SQL that replays the small models step by step: the check of fits, scores and comparisons."""

from __future__ import annotations

from featsel.operators.stats import TINY


def dealt(source: str, key: str, label: str | None, seed: int, folds: int = 3) -> str:
    """CTE `dealt`: the rows of `source` with their fold."""
    by = f"partition by {label} " if label else ""
    return f", dealt as (select *, ((row_number() over ({by}order by md5('{seed}:' || {key})) - 1) % {folds})::int as fold from {source})"


def models(names: list[str], target: str, folds: int = 3) -> str:
    """CTE `model`: for every set of `sets` (set_id, state as a bit mask) and fold the rows, means (m), deviations (sd, 1 if hardly
    any) of all other folds, which inputs count (u), and zero weights. The target comes last in m and sd."""
    each = [*names, target]
    sd = lambda c: f"case when var_pop({c}) > {TINY} then sqrt(var_pop({c})) else 1 end"
    return f""", stat as (
  select f as fold, count(*) as n, [{', '.join(f'avg({c})' for c in each)}] as m, [{', '.join(map(sd, each))}] as sd,
         [{', '.join('[' + ', '.join(f'covar_pop({a}, {b})' for b in each) + ']' for a in each)}] as c
  from dealt, range({folds}) t(f) where dealt.fold <> f group by f
), model as (select set_id, stat.*, [{', '.join(f'((state >> {i}) & 1)::double' for i in range(len(names)))}] as u, [{', '.join(['0.0::double'] * len(names))}] as zero from sets, stat)"""


def linear(names: list[str], steps: int = 64) -> str:
    """CTE `weights` (set_id, fold, v, b0, on the inputs' own scale) of the linear models, by recursion over the moments."""
    d = len(names)
    z = lambda i, j: f"c[{i}][{j}] / (sd[{i}] * sd[{j}])"
    pull = lambda i: " + ".join(f"{z(i, j)} * w[{j}]" for j in range(1, d + 1))
    new = ", ".join(f"w[{i}] - 0.075 / (1 + 0.009 * e) * u[{i}] * ({pull(i)} - {z(i, d + 1)} + 0.01 * w[{i}])" for i in range(1, d + 1))
    return f""", fit as (
  select 0 as e, set_id, fold, zero as w from model
  union all
  select e + 1, fit.set_id, fit.fold, [{new}] from fit join model on model.set_id = fit.set_id and model.fold = fit.fold where e < {steps}
), scaled as (select model.*, [{', '.join(f'w[{i}] * sd[{d + 1}] / sd[{i}]' for i in range(1, d + 1))}] as v from fit join model on model.set_id = fit.set_id and model.fold = fit.fold where e = {steps}
), weights as (select set_id, fold, v, m[{d + 1}] - {' - '.join(f'v[{i}] * m[{i}]' for i in range(1, d + 1))} as b0 from scaled)"""


def logistic(names: list[str], label: str, steps: int = 64) -> str:
    """CTE `weights` of the logistic models, by recursion over the rows."""
    d = len(names)
    z = [f"({c} - m[{i}]) / sd[{i}]" for i, c in enumerate(names, 1)]
    term = " + ".join(f"w[{i}] * {x}" for i, x in enumerate(z, 1))
    step = "0.16 / (1 + 0.012 * e)"
    new = ", ".join(f"w[{i}] - {step} * (u[{i}] * g{i} / n + 0.012 * w[{i}])" for i in range(1, d + 1))
    return f""", fit as (
  select 0 as e, set_id, fold, zero as w, 0.0::double as b, u, m, sd, n from model
  union all
  select e + 1, set_id, fold, [{new}], b - {step} * g0 / n, u, m, sd, n from (
    select e, set_id, fold, w, b, u, m, sd, n, sum(err) as g0, {', '.join(f'sum(err * z{i}) as g{i}' for i in range(1, d + 1))} from (
      select fit.*, 1 / (1 + exp(-greatest(-35, least(35, b + {term})))) - {label} as err, {', '.join(f'{x} as z{i}' for i, x in enumerate(z, 1))}
      from fit join dealt on dealt.fold <> fit.fold where e < {steps}
    ) group by e, set_id, fold, w, b, u, m, sd, n
  )
), scaled as (select set_id, fold, m, b, [{', '.join(f'w[{i}] / sd[{i}]' for i in range(1, d + 1))}] as v from fit where e = {steps}
), weights as (select set_id, fold, v, b - {' - '.join(f'v[{i}] * m[{i}]' for i in range(1, d + 1))} as b0 from scaled)"""


def predicted(names: list[str], target: str, is_logistic: bool) -> str:
    """CTE `p` (set_id, label, p): every row by the models that didn't see it."""
    term = "b0 + " + " + ".join(f"v[{i}] * {c}" for i, c in enumerate(names, 1))
    value = f"1 / (1 + exp(-greatest(-35, least(35, {term}))))" if is_logistic else term
    return f", p as (select set_id, {target} as label, {value} as p from dealt join weights on weights.fold = dealt.fold)"


def scores(is_logistic: bool) -> str:
    """CTE `metrics` (set_id, score, secondary, loss, n) of `p`."""
    if not is_logistic:
        return """, metrics as (
  select set_id, case when var_pop(label) * count(*) > 1e-15 then 1 - sum((label - p) ** 2) / (var_pop(label) * count(*)) else 0 end as score,
         sqrt(avg((label - p) ** 2)) as secondary, sqrt(avg((label - p) ** 2)) as loss, count(*) as n from p group by set_id)"""
    return """, placed as (select *, row_number() over (partition by set_id order by p) as rn from p
), ranked as (select set_id, label, avg(rn) over (partition by set_id, p) as rank from placed
), area as (select set_id, (sum(rank * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) as score from ranked group by set_id
), rest as (select set_id, avg(((p >= 0.5)::int = label)::int) as secondary, -avg(case when label = 1 then ln(greatest(p, 1e-9)) else ln(1 - least(p, 1 - 1e-9)) end) as loss, count(*) as n from p group by set_id
), metrics as (select * from area join rest using (set_id))"""


def report(is_logistic: bool, set_id: str = "set_id") -> str:
    """The rows of `evaluate.evaluate_subsets` (needs `sets` with state)."""
    one, two, three = ("ROC AUC", "Accuracy", "Log loss") if is_logistic else ("R²", "RMSE", "RMSE")
    return f""" select {set_id}, round(score, 6) as score, '{one}' as score_label, round(secondary, 6) as secondary, '{two}' as secondary_label, round(loss, 6) as loss,
  '{three}' as loss_label, 3 as cv_folds, n as validation_samples, (2 * bit_count(state) + 1)::int as proxy_ops from metrics join sets using (set_id)"""
