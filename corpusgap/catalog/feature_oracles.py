"""SQL for DuckDB for pairs, feature tables and regression."""

from __future__ import annotations

from corpusgap.catalog import oracles as o
from corpusgap.functions import fixed_values as fixed

SIDES = ("source", "target")

RESOLVED_SCORES = """resolved_scores as (
  select r.*, f.ft,
    case when f.ft then 'test' else r.source_split end as source_score_split,
    case when f.ft then 'test' else r.target_split end as target_score_split,
    case when f.ft then 'tuned' else 'base' end as source_model,
    case when f.ft and r.da_type <> 'in-domain-adapt' then 'tuned' else 'base' end as target_model
  from resolved r, (select unnest([false, true]) as ft) f)"""


def unit(key: str) -> str:
    return f"cast('0x' || substr(md5({key}), 1, 8) as bigint) / 4294967296.0::double"


def side_columns(fill: bool) -> str:
    parts = []
    for side, alias in zip(SIDES, "st"):
        for m in fixed.METRICS:
            value = f'{alias}."{m}"'
            if fill:
                key = f"'{side}|{m}|' || {side} || '|' || {side}_score_split || '|' || {side}_model"
                value = f"case when {alias}.ds is null then {unit(key)} else {value} end"
            parts.append(f'{value} as "{side}_{m}"')
        parts.append(f"{alias}.ds is null as {side}_is_missing")
    return ",\n    ".join(parts)


def joined(fill: bool) -> str:
    mean = {s: "(" + " + ".join(f'"{s}_{m}"' for m in fixed.METRICS) + ") / 12.0::double"
            for s in SIDES}
    return f"""joined as (
  select r.*, {side_columns(fill)}
  from resolved_scores r
  left join scores s on s.ds = r.source and s.split = r.source_score_split and s.model = r.source_model
  left join scores t on t.ds = r.target and t.split = r.target_score_split and t.model = r.target_model),
drops as (
  select *, {mean["source"]} as weighted_y_source, {mean["target"]} as weighted_y_target,
         {mean["source"]} - {mean["target"]} as y_drop from joined)"""


def rounds(names, digits: int = 6) -> str:
    return ", ".join(f'round("{n}", {digits}) as "{n}"' for n in names)


SCORE_SIDES = [f"{s}_{m}" for s in SIDES for m in fixed.METRICS]
MEANS = ["weighted_y_source", "weighted_y_target", "y_drop"]
SCORE_PAIRS = f"{o.SCORES}, {o.PAIRS}, {RESOLVED_SCORES}"


def feature_table(fill: bool, compat: bool = False) -> str:
    """Common table expressions up to `features`, with names as in the pair feature table."""
    on = ("d.source = f.target and d.target = f.source" if compat
          else "d.source = f.source and d.target = f.target")
    means = ("weighted_y_target as weighted_y_source, weighted_y_source as weighted_y_target"
             if compat else "weighted_y_source, weighted_y_target")
    return f"""with recursive {o.TERMS_AND_TFIDF}, {o.DISTANCES_CTE}, {o.SCORES}, {RESOLVED_SCORES},
{joined(fill)}, {o.PARSE.removeprefix(o.CORPUS + ",")}{o.DEPTHS}, {o.DIFFICULTY},
features as (
  select f.da_type as "da-type", f.source, f.target, f.ft, h.difficult as learning_difficult,
    {", ".join(f'd."{n}"' for n in fixed.DISTANCES)},
    {", ".join(f'f."{n}"' for n in SCORE_SIDES)}, {means}, y_drop,
    f.da_type || '|' || f.source || '|' || f.target || '|' || f.ft as row_key
  from drops f
  left join distances d on {on} and d.source_split = f.source_split and d.target_split = f.target_split
  left join difficulty h on h.domain = f.target and h.split = 'test')"""


KEYS = '"da-type", source, target, ft'
NUMBERS = [fixed.DIFFICULTY, *fixed.DISTANCES, *SCORE_SIDES, *MEANS]
FEATURES = feature_table(fill=True)


def plus(names) -> str:
    return " + ".join(f'"{n}"' for n in names)


def with_drop(source: str, target: str) -> str:
    return (f"round({source}, 6) as weighted_y_source, round({target}, 6) as weighted_y_target, "
            f"round({source} - {target}, 6) as y_drop")


ROUGE = {s: [f"{s}_{m}" for m in fixed.BASELINE_METRICS] for s in SIDES}
ROUGE_MEAN = {s: f"(({plus(ROUGE[s])}) / 3.0::double)" for s in SIDES}


def group_mean(side: str, members) -> str:
    values = ", ".join(f'"{side}_{m}"' for m in members)
    return f"list_avg([{values}])"


GROUP_MEANS = {f"{s}_{g}": group_mean(s, members) for s in SIDES
               for g, members in fixed.METRIC_GROUPS.items()}
REDUCED_MEAN = {
    s: "((" + " + ".join(v for k, v in GROUP_MEANS.items() if k.startswith(f"{s}_")) + ") / 5.0::double)"
    for s in SIDES
}

LIMITS = {
    **{fixed.DIFFICULTY: (0, 100)},
    **{d: (0, 100) for d in fixed.DISTANCES if d != "contextual-overlap"},
    **{f"{s}_{m}": (-1, 1) for s in SIDES for m in ("bert_precision", "bert_recall", "bert_f1")},
    **{f"{s}_vocab_overlap": (0, 100) for s in SIDES},
    **{f"{s}_Fluency": (1, 3) for s in SIDES},
    **{f"{s}_{m}": (1, 5) for s in SIDES for m in ("Relevance", "Coherence", "Consistency")},
}


def normal_columns() -> str:
    """All numbers, those with limits rescaled to 0 .. 1."""
    columns = []
    for n in [fixed.DIFFICULTY, *fixed.DISTANCES, *SCORE_SIDES]:
        if n in LIMITS:
            low, high = LIMITS[n]
            columns.append(f'least(1.0::double, greatest(0.0::double, ("{n}" - {low}) / ({high - low})::double)) as "{n}"')
        else:
            columns.append(f'"{n}"')
    return ", ".join(columns)


NORM = f"{FEATURES}, norm as (select {KEYS}, row_key, {normal_columns()} from features)"


def normalized(compat: bool) -> str:
    sums = {}
    for s in SIDES:
        names = [f"{s}_{m}" for m in fixed.METRICS] + ([f"{s}_shannon_entropy"] if compat else [])
        sums[s] = f"(({plus(names)}) / {len(names)}.0::double)"
    return f"""{NORM}
select {KEYS}, row_key, {rounds([fixed.DIFFICULTY, *fixed.DISTANCES, *SCORE_SIDES])},
  {with_drop(sums["source"], sums["target"])} from norm"""


ALL_MEAN = {s: f"(({plus([f'{s}_{m}' for m in fixed.METRICS])}) / 12.0::double)" for s in SIDES}
NOT_REDUNDANT = [n for n in fixed.DOMAIN_FEATURES if n not in ("js-divergence", "vocab-overlap", "source_shannon_entropy")]
# columns of the design matrices on normalized features, and their label
BASELINE_NORM = [*fixed.DOMAIN_FEATURES, *ROUGE["source"]]
ALL_NORM = [fixed.DIFFICULTY, *[d for d in fixed.DISTANCES if d != "source_shannon_entropy"], *[f"source_{m}" for m in fixed.METRICS]]


def drop_of(means: dict[str, str]) -> str:
    return f"{means['source']} - {means['target']}"


def matrix(source: str, columns: list[str], means: dict[str, str], more: dict[str, str] | None = None) -> str:
    """SQL of a design matrix: row key, rounded columns, and the drop of these means."""
    extra = "".join(f', round({v}, 6) as "{k}"' for k, v in (more or {}).items())
    with_ = FEATURES if source == "features" else NORM
    return f"{with_} select row_key, {rounds(columns)}{extra}, round({drop_of(means)}, 6) as y_drop from {source}"


DESIGN_MATRICES = {
    "design_matrix_baseline_raw": matrix("features", BASELINE_NORM, ROUGE_MEAN),
    "design_matrix_baseline_norm": matrix("norm", BASELINE_NORM, ROUGE_MEAN),
    "design_matrix_baseline_norm_red": matrix("norm", NOT_REDUNDANT, ROUGE_MEAN, {"rouge_source": ROUGE_MEAN["source"]}),
    "design_matrix_all_norm": matrix("norm", ALL_NORM, ALL_MEAN),
    "design_matrix_all_red": matrix("norm", NOT_REDUNDANT, REDUCED_MEAN,
                                    {k: v for k, v in GROUP_MEANS.items() if k.startswith("source_")}),
}


def run_rows(mode: str, columns: list[str], means: dict[str, str]) -> str:
    return f"""select '{mode}' as features, row_key, source, [{", ".join(f'"{c}"' for c in columns)}]::double[] as x,
    {drop_of(means)} as y from norm"""


# Least squares of every run and part by Gauss-Jordan elimination of the normal equations. On these tables
# the root of the rows is above the number of columns, so that feature selection leaves none out.
SWEEP_LINEAR = f"""{NORM},
modes as ({run_rows("baseline-norm", BASELINE_NORM, ROUGE_MEAN)} union all {run_rows("all-norm", ALL_NORM, ALL_MEAN)}),
marked as (
  select features, c.n, y, x, {o.bucket("row_key", 100)} < 33 as is_test, {o.bucket("row_key", 3)} as fold
  from modes join (select source, dense_rank() over (order by source) as number from (select distinct source from norm)) using (source)
  join (select unnest([10, 11, 12, 13, 14])::int as n) c on number <= c.n),
places as (select features, n, is_test, unnest(x) as v, unnest(range(1, len(x) + 1)) as i from marked),
stats as (select features, n, list(m order by i) as m, list(s order by i) as s from (
  select features, n, i, avg(v) as m, stddev_pop(v) as s from places where not is_test group by all) group by all),
scaled as (
  select features, n, y, is_test, fold,
    list_prepend(1.0::double, list_transform(x, lambda v, i: (v - m[i]) / case when s[i] = 0 then 1.0 else s[i] end)) as x
  from marked join stats using (features, n)),
parts as (select unnest([-1, 0, 1, 2]) as part),
fits as (
  select features, n, part, x, y from scaled, parts where case when part < 0 then not is_test else fold <> part end),
cells as (
  select features, n, part, i, j, sum(x[i] * case when j > len(x) then y else x[j] end) as v
  from (select *, unnest(range(1, len(x) + 1)) as i from fits) q, lateral (select unnest(range(1, len(q.x) + 2)) as j) l
  group by all),
start as (select features, n, part, list(r order by i) as m from (
  select features, n, part, i, list(v order by j) as r from cells group by all) group by all),
elimination as (
  select 1 as k, * from start
  union all
  select k + 1, features, n, part, list_transform(m, lambda r, i: case when i = k then list_transform(r, lambda v: v / r[k])
    else list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) end)
  from elimination where k <= len(m)),
solved as (select features, n, part, list_transform(m, lambda r: r[len(r)]) as b from elimination where k = len(m) + 1),
errors as (
  select features, n, part, y, list_dot_product(x, b) - y as e
  from scaled join solved using (features, n) where case when part < 0 then is_test else fold = part end),
part_scores as (
  select features, n, part, avg(e * e) as mse, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse, 1 - avg(e * e) / var_pop(y) as r2
  from errors group by all),
used as (select features, n, count(*) as rows_used from marked group by all)
select features, feature_selection, n as num_datasets, rows_used,
  {", ".join(f"round(max({v}) filter (part < 0), 3) as {v}" for v in ("mse", "mae", "rmse", "r2"))},
  {", ".join(f'round(avg({v}) filter (part >= 0), 3) as "k-fold-{v}"' for v in ("mse", "mae", "rmse", "r2"))}
from part_scores join used using (features, n), (select unnest([false, true]) as feature_selection)
group by all"""

LINE = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
LINE_KEY = "l_orderkey || '-' || l_linenumber"
LINES = f"""lines as (
  select {LINE_KEY} as row_key, l_extendedprice as y, l_returnflag,
         {", ".join(f'{c}::double as x{i}' for i, c in enumerate(LINE))},
         {o.bucket(LINE_KEY, 100)} < 33 as is_test, {o.bucket(LINE_KEY, 5)} as fold,
         {o.bucket(LINE_KEY, 3)} as kfold
  from lineitem),
scaled as (
  select l.* exclude ({", ".join(f"x{i}" for i in range(4))}),
         {", ".join(f"(x{i} - m{i}) / s{i} as x{i}" for i in range(4))}
  from lines l, (select {", ".join(f"avg(x{i}) as m{i}, stddev_pop(x{i}) as s{i}" for i in range(4))}
                 from lines where not is_test)),
train as (select * from scaled where not is_test)"""


def products(table: str, by: str = "1") -> str:
    """n, means and centred column products of x0..x3 and y per group."""
    pairs = [f"covar_pop(x{i}, x{j}) * count(*) as g{i}{j}" for i in range(4) for j in range(i, 4)]
    cross = [f"covar_pop(x{i}, y) * count(*) as c{i}" for i in range(4)]
    means = [f"avg(x{i}) as m{i}" for i in range(4)]
    return (f"select {by} as part, count(*)::double as n, avg(y) as my, var_pop(y) as vy, "
            f"{', '.join(means + pairs + cross)} from {table} group by 1")


def g(i: int, j: int) -> str:
    return f"g{min(i, j)}{max(i, j)}"


def step(right: str = "c{i}", ridge: str = "0", soft: str | None = None) -> str:
    """One round of coordinate descent: four lateral columns n0..n3."""
    out = []
    for i in range(4):
        rest = " - ".join([right.format(i=i)] + [f"{g(i, j)} * {'n' if j < i else 'b'}{j}"
                                                 for j in range(4) if j != i])
        if soft:
            out.append(f"{rest} as r{i}")
            out.append(f"sign(r{i}) * greatest(abs(r{i}) - {soft}, 0) / {g(i, i)} as n{i}")
        else:
            out.append(f"({rest}) / ({g(i, i)} + {ridge}) as n{i}")
    return ", ".join(out)


def coefficients(table: str, penalty: str, intercept: str = "my") -> str:
    rows = [f"select 'intercept' as feature, round({penalty}, 4) as penalty, round({intercept}, 4) as coefficient from {table}"]
    rows += [f"select '{c}', round({penalty}, 4), round(b{i}, 4) from {table}" for i, c in enumerate(LINE)]
    return "\nunion all ".join(rows)


ZERO = "0.0::double as b0, 0.0::double as b1, 0.0::double as b2, 0.0::double as b3"
NEW = "n0, n1, n2, n3"

RIDGE = f"""with recursive {LINES}, m as ({products("train")}),
penalties as (select unnest([0.1, 1.0, 10.0])::double as a),
cd as (
  select 0 as it, a, k, {ZERO} from penalties, (select unnest(range(-1, 4)) as k)
  union all
  select it + 1, a, k, {NEW} from (
    select cd.*, m.*, {step("(case when k = -1 then c{i} when k = {i} then 1.0 else 0.0 end)", "a")}
    from cd, m where it < 60)),
solved as (select * from cd where it = 60),
inverse as (
  select a, {", ".join(f"max(b{i}) filter (k = {k}) as v{i}{k}" for i in range(4) for k in range(4))}
  from solved group by a),
loo as (
  select a, avg(power((y - my - ({" + ".join(f"b{i} * x{i}" for i in range(4))}))
    / (1 - 1 / n - ({" + ".join(f"x{i} * x{k} * v{i}{k}" for i in range(4) for k in range(4))})), 2)) as e
  from train, m, inverse join solved using (a) where k = -1 group by a),
best as (select solved.*, my from solved, m where k = -1 and a = (select a from loo order by e, a limit 1))
{coefficients("best", "a")}"""

OLS = f"""with recursive {LINES}, m as ({products("train")}),
cd as (
  select 0 as it, {ZERO}
  union all
  select it + 1, {NEW} from (select cd.*, m.*, {step()} from cd, m where it < 60)),
best as (select cd.*, my from cd, m where it = 60)
{coefficients("best", "0.0::double")}"""

LASSO = f"""with recursive {LINES}, m as ({products("train")}),
path as (select i, greatest({", ".join(f"abs(c{i})" for i in range(4))}) / n * power(0.001, i / 99.0) as a
         from m, (select unnest(range(0, 100)) as i)),
folds as (select distinct fold from train),
others as (select f.fold as other, t.* from folds f join train t on t.fold <> f.fold),
fm as ({products("others", "other")}),
cd as (
  select 0 as it, part, i, a, {ZERO} from fm, path
  union all
  select it + 1, part, i, a, {NEW} from (
    select cd.it, cd.i, cd.a, cd.b0, cd.b1, cd.b2, cd.b3, fm.*, {step(soft="n * a")}
    from cd join fm on fm.part = cd.part where it < 60)),
errors as (
  select cd.part, i, avg(power(y - my - ({" + ".join(f"b{i} * (x{i} - m{i})" for i in range(4))}), 2)) as e
  from cd join fm on fm.part = cd.part join train t on t.fold = cd.part where it = 60 group by 1, 2),
chosen as (select a from path where i = (select i from errors group by i order by avg(e), i limit 1)),
last as (
  select 0 as it, a, {ZERO} from chosen
  union all
  select it + 1, a, {NEW} from (select last.*, m.*, {step(soft="n * a")} from last, m where it < 60)),
best as (select last.*, my from last, m where it = 60)
{coefficients("best", "a")}"""

KFOLD = f"""with recursive {LINES},
others as (select f.kfold as other, t.* from (select distinct kfold from lines) f
           join lines t on t.kfold <> f.kfold),
fm as ({products("others", "other")}),
cd as (
  select 0 as it, part, {ZERO} from fm
  union all
  select it + 1, part, {NEW} from (
    select cd.it, cd.b0, cd.b1, cd.b2, cd.b3, fm.*, {step()}
    from cd join fm on fm.part = cd.part where it < 60)),
predicted as (
  select t.kfold, y, my + {" + ".join(f"b{i} * (x{i} - m{i})" for i in range(4))} as p
  from cd join fm on fm.part = cd.part join lines t on t.kfold = cd.part where it = 60),
per_fold as (
  select kfold, avg(power(y - p, 2)) as mse, avg(abs(y - p)) as mae,
         1 - avg(power(y - p, 2)) / var_pop(y) as r2 from predicted group by 1)
select round(avg(mse), 4) as mse, round(avg(mae), 4) as mae, round(avg(sqrt(mse)), 4) as rmse,
       round(avg(r2), 4) as r2 from per_fold"""


def standardized(compat: bool) -> str:
    part = "l.is_test" if compat else "false"
    return f"""with {LINES},
st as (select is_test, {", ".join(f"avg(x{i}) as m{i}, stddev_pop(x{i}) as s{i}" for i in range(4))}
       from lines group by is_test)
select row_key, l.is_test, {", ".join(f'round((x{i} - m{i}) / s{i}, 6) as "{c}"' for i, c in enumerate(LINE))}
from lines l join st on st.is_test = {part}"""


def f_score(column: str, label: str) -> str:
    r2 = f'power(corr("{column}", {label}), 2)'
    return f"{r2} / (1 - {r2}) * (count(*) - 2)"


FIRST = """numbered as (select source, dense_rank() over (order by source) as number
             from (select distinct source from drops)),
counts as (select unnest([10, 11, 12, 13, 14])::int as n)"""

NO_DROP = """avg(power(v, 2)) as mse, avg(abs(v)) as mae, sqrt(avg(power(v, 2))) as rmse,
         1 - avg(power(v, 2)) / var_pop(v) as r2"""

NATION = """nations as (
  select n_nationkey, n_regionkey, length(n_name) as name_length, n_nationkey % 4 as quarters,
         n_nationkey % 3 as thirds, n_nationkey % 7 as sevenths, n_nationkey * n_nationkey % 11 as label from nation)"""
NATION_COLUMNS = ["n_nationkey", "n_regionkey", "name_length", "quarters", "thirds", "sevenths"]
TUNED_ONLY = FEATURES.replace("where not (t = 1 and", "where not (t = 0 and ds = 'src5') and not (t = 1 and")

FEATURE_SQL = {
    **DESIGN_MATRICES,
    "score_duplicates": f"""
with {SCORE_PAIRS}, {joined(False)}
select da_type, source, target, ft, round(source_rouge1 / 2, 6) as source_rouge1,
       round(target_bert_f1 / 2, 6) as target_bert_f1, target_is_missing from joined""",
    "pair_features_first_domains": f"""{feature_table(False)},
first as (select distinct source as domain from documents order by 1 limit 8)
select {KEYS}, {rounds(NUMBERS)} from features
where not ft and source in (select domain from first) and target in (select domain from first)""",
    "training_corpus_tuned_only": f"""{TUNED_ONLY}
select {KEYS}, {rounds(NUMBERS)} from features where ft or (source <> 'src5' and target <> 'src5')""",
    "f_regression_edges": f"""
select 'constant' as feature, false as perfect, 0.0::double as f_score
union all select 'copy', true, null
union all select 'l_discount', false, round({f_score('l_discount', 'l_extendedprice')}, 3) from lineitem
union all select 'with_nulls', false, round({f_score('l_quantity', 'l_extendedprice')}, 3) from lineitem where l_linenumber > 1""",
    "selection_default_k": f"""
with {NATION}, found as (
  {" union all ".join(f"select {i} as pos, '{c}' as feature, {f_score(c, 'label')} as f from nations" for i, c in enumerate(NATION_COLUMNS))})
select feature from found order by f desc, pos limit 3""",
    "sweep_linear": SWEEP_LINEAR,
    "domain_pairs": f"with {o.PAIRS} select * from pairs",
    "pair_resolution": f"with {o.PAIRS}, {RESOLVED_SCORES} select * from resolved_scores",
    "score_lookup": f"""
with {SCORE_PAIRS}, {joined(False)}
select da_type, source, target, ft, source_score_split, target_score_split, source_model,
       target_model, source_is_missing, target_is_missing, {rounds(SCORE_SIDES)} from joined""",
    "score_missing": f"""
with {SCORE_PAIRS}, {joined(True)}
select da_type, source, target, source_is_missing, target_is_missing,
       {rounds(["source_rouge1", "target_fs_grounded"])}
from joined where ft and (source_is_missing or target_is_missing)""",
    "score_slices": f"""
with {o.SCORES}
select ds, split, model, {rounds(fixed.METRICS)}, 'zero-shot' as slice from scores where model = 'base'
union all
select ds, split, model, {rounds(fixed.METRICS)}, 'fine-tuned' from scores
where split = 'test' and ds <> 'src3'""",
    "first_n_domains": f"""
with {o.PAIRS}, {RESOLVED_SCORES}
select da_type, source, target, ft from resolved_scores
where source in (select domain from domains order by domain limit 12)""",
    "weighted_average": """
select l_orderkey, l_linenumber, round((l_quantity + 2 * l_discount + 3 * l_tax) / 6, 6) as weighted_mean
from lineitem""",
    "performance_drop": f"""
with {SCORE_PAIRS}, {joined(True)} select da_type, source, target, ft, {rounds(MEANS)} from drops""",
    "pair_features": f"""{feature_table(False)}
select {KEYS}, {rounds(NUMBERS)} from features where not ft""",
    "pair_features_compat": f"""{feature_table(False, compat=True)}
select {KEYS}, {rounds(NUMBERS)} from features where not ft""",
    "training_corpus": f"{FEATURES} select {KEYS}, {rounds(NUMBERS)} from features",
    "baseline_features": f"""{FEATURES}
select row_key, target, {rounds([*fixed.DOMAIN_FEATURES, *ROUGE["source"], *ROUGE["target"]])},
  {with_drop(ROUGE_MEAN["source"], ROUGE_MEAN["target"])} from features""",
    "baseline_features_reduced": f"""{FEATURES}
select row_key, target, {rounds(fixed.DOMAIN_FEATURES)},
  round({ROUGE_MEAN["source"]}, 6) as rouge_source, round({ROUGE_MEAN["target"]}, 6) as rouge_target,
  {with_drop(ROUGE_MEAN["source"], ROUGE_MEAN["target"])} from features""",
    "reduced_features": f"""{FEATURES}
select row_key, target, {rounds(fixed.DOMAIN_FEATURES)},
  {", ".join(f'round({v}, 6) as "{k}"' for k, v in GROUP_MEANS.items())},
  {with_drop(REDUCED_MEAN["source"], REDUCED_MEAN["target"])} from features""",
    "normalize_features": normalized(False),
    "normalize_features_compat": normalized(True),
    "mode_design_matrix": f"""{FEATURES}
select row_key, {rounds([n for n in NUMBERS if not n.startswith(("target_", "weighted_")) and n != "source_shannon_entropy"] + ["target_shannon_entropy"])}
from features""",
    "category_index": f"""
with {o.PAIRS}, {RESOLVED_SCORES}
select da_type || '|' || source || '|' || target || '|' || ft as row_key,
  case da_type when 'in-domain-adapt' then 0.0::double when 'no-domain-adapt' then 1.0 else 2.0 end as "da-type",
  case when ft then 1.0::double else 0.0 end as ft
from resolved_scores""",
    "standardize": standardized(False),
    "standardize_compat": standardized(True),
    "f_regression": "\nunion all ".join(
        f"select {i} as position, '{c}' as feature, round({f_score(c, 'l_extendedprice')}, 3) as f_score from lineitem"
        for i, c in enumerate(LINE)),
    "ols_simple": """
select round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem""",
    "ols_fit": OLS,
    "ridge_fit": RIDGE,
    "lasso_fit": LASSO,
    "regression_metrics": """
select l_returnflag, round(avg(power(d, 2)), 4) as mse, round(avg(abs(d)), 4) as mae,
       round(sqrt(avg(power(d, 2))), 4) as rmse,
       round(1 - avg(power(d, 2)) / var_pop(l_extendedprice), 4) as r2
from (select *, l_extendedprice - l_quantity * 1500.0::double as d from lineitem) group by l_returnflag""",
    "kfold_scores": KFOLD,
    "selection_counts": f"""
with {SCORE_PAIRS}, {joined(True)}, {FIRST},
found as (
  {" union all ".join(f"select n, {i} as pos, 'source_{m}' as feature, {f_score(f'source_{m}', 'y_drop')} as f from drops join numbered using (source) join counts on number <= n group by n" for i, m in enumerate(fixed.METRICS))}),
chosen as (select * from found qualify row_number() over (partition by n order by f desc, pos) <= 5)
select 'all-raw' as features, feature, count(*) as times from chosen group by feature""",
    "result_compare": f"""
with {SCORE_PAIRS}, {joined(True)}, {FIRST},
kept as (select n, y_drop, {ROUGE_MEAN["source"]} - {ROUGE_MEAN["target"]} as rouge_drop
         from drops join numbered using (source) join counts on number <= n),
a as (select n, {NO_DROP} from (select n, y_drop as v from kept) group by n),
b as (select n, {NO_DROP} from (select n, rouge_drop as v from kept) group by n)
select n as num_datasets, round(a.r2, 6) as "All_r2", round(b.r2, 6) as "ROUGE_r2",
       round(a.rmse, 6) as "All_rmse", round(b.rmse, 6) as "ROUGE_rmse"
from a join b using (n)""",
}
