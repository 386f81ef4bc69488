"""Code metrics: the SQL works on one row per line, the library on arrays inside a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import RX_NOT_WORD, RX_WS, check, sql_np_round, sql_py_round, sql_strip, with_
from quillgauge.operators import code_metrics as cm

D = ("d", views.V_DIAGRAMS)
L = (
    "l",
    f"select story_id, variant, {sql_strip('raw')} as line, pos from (select story_id, variant, "
    "unnest(string_split(code, chr(10))) as raw, generate_subscripts(string_split(code, chr(10)), 1) as pos from d)",
)
IS = {
    "activities": "starts_with(line, ':') and ends_with(line, ';') and not regexp_matches(lower(line), "
                  "'then|else|case|while|until|repeat') and "
                  + sql_strip("substr(line, 2, greatest(length(line) - 2, 0))") + " <> ''",
    "ifs": f"regexp_matches(line, '^if{RX_WS}+.*{RX_WS}+then({RX_NOT_WORD}|$)', 'i')",
    "switches": rf"regexp_matches(line, '^switch{RX_WS}*\(.*\)', 'i')",
    "forks": "regexp_matches(line, '^(fork|split)$', 'i')",
    "swimlanes": r"regexp_matches(line, '^\|[^|]+\|$')",
    "detaches": "regexp_matches(line, '^detach$', 'i')",
    "options": "contains(line, ':') and contains(lower(line), 'option') and ends_with(line, ';')",
    "notes": f"regexp_matches(line, '^note{RX_WS}+', 'i')",
    "partitions": f"regexp_matches(line, '^partition{RX_WS}+', 'i')",
    "numberline": "line <> '' and not starts_with(line, '''') and not starts_with(line, '@')",
    "endifs": "regexp_matches(line, '^endif$', 'i')",
    "joins": f"regexp_matches(line, '^(join|end{RX_WS}*fork)$', 'i')",
    "endswitches": "regexp_matches(line, '^endswitch$', 'i')",
    "starts": "regexp_matches(line, '^start$', 'i')",
    "stops": "regexp_matches(line, '^(stop|end)$', 'i')",
}
FLOW = rf"""case when line = '' then null
 when regexp_matches(line, '^:[^:]*;$') then 'activity'
 when regexp_matches(line, '^if{RX_WS}*\(.*\)', 'i') then 'decision'
 when regexp_matches(line, '^start$', 'i') then 'start'
 when regexp_matches(line, '^(stop|end)$', 'i') then 'stop'
 when regexp_matches(line, '^(then|else)', 'i') then 'branch'
 when regexp_matches(line, '^endif$', 'i') then 'endif'
 when regexp_matches(line, '^fork$', 'i') then 'fork'
 when regexp_matches(line, '^(join|end{RX_WS}*fork)$', 'i') then 'join' end"""
E_ = ("e", f"select * from (select story_id, variant, line, pos - 1 as position, {FLOW} as type from l) where type is not null")
N = (
    "n",
    "select story_id, variant, "
    + ", ".join(f"count(*) filter (where {rule}) as {name}" for name, rule in IS.items())
    + " from l group by all",
)
# Orphans: nearest neighbours by window over the flow elements instead of array slices.
O = (
    "o",
    """select story_id, count(*) as orphans from (
  select a.*, d.code, row_number() over w as rn, row_number() over (partition by a.story_id order by position desc) as back
  from (select *,
      max(case when type in ('activity','decision','branch','endif','start') then position end)
        over (partition by story_id order by position rows between unbounded preceding and 1 preceding) as before,
      min(case when type in ('activity','decision','stop','endif') then position end)
        over (partition by story_id order by position rows between 1 following and unbounded following) as after,
      min(case when type = 'start' then position end) over (partition by story_id) as first_start,
      min(case when type = 'stop' then position end) over (partition by story_id) as first_stop
    from e) a join d using (story_id) where type = 'activity' window w as (partition by a.story_id order by position))
where not (contains(code, concat('->', line)) or contains(code, concat(line, '->'))
  or coalesce(case when rn = 1 then first_start < position when back = 1 then first_stop > position
      else position - before <= 10 and after - position <= 10 end, false))
group by story_id""",
)
C = (
    "c",
    r"""select d.story_id, d.variant, d.model_group, d.code, activities, ifs + switches as decisions, forks, swimlanes, detaches,
  options, length(regexp_extract_all(code, '->{1,2}|<-{1,2}'))::bigint as edges, notes, partitions, numberline,
  endifs, joins, switches, endswitches, starts, stops,
  case when activities > 1 then coalesce(orphans, 0) else 0 end as orphans,
  numberline / activities as ratio,
  case when activities + ifs + switches + forks <= 5 then 4.5::double when activities + ifs + switches + forks <= 15 then 3.5::double
    else 3.0::double end as threshold
from n join d using (story_id) left join o using (story_id)""",
)
P = (
    "p",
    """select *, case when activities > 0 and ratio > threshold then ratio - threshold end as excess,
  (case when activities > 0 and ratio > threshold then ratio - threshold end) * (-0.3)::double as pss,
  abs(decisions - endifs) as if_gap, abs(forks - joins) as fork_gap, abs(switches - endswitches) as switch_gap from c""",
)
S = (
    "s",
    """select *, (-3 * fork_gap - 3 * switch_gap - case when starts = 0 then 10 else 0 end
   - case when stops = 0 then 10 else 0 end)::double + coalesce(pss, 0::double) as negative_score from p""",
)
_POS = """0::double + activities * 3::double + decisions * 4::double + forks * 3::double + swimlanes * 2::double
 + edges * 1.2::double + notes * 0.8::double + partitions * 1.5::double + options * 1::double + numberline * 0.05::double"""
R = (
    "r",
    f"""select *, 0::double + activities * 3::double + decisions * 4::double + forks * 3::double + swimlanes * 2::double
 + detaches * (-1.5)::double + options * 1::double + edges * 1.2::double + notes * 0.8::double + partitions * 1.5::double
 + numberline * 0.05::double + negative_score * 1::double as raw, greatest({_POS} + 20::double, 10::double) as ceiling from s""",
)
M = (
    "m",
    f"""select story_id, variant, model_group, code, activities, decisions, forks, swimlanes, detaches, options, edges, notes,
  partitions, numberline, negative_score, {sql_py_round('raw', 2)} as raw_score, percent,
  {sql_py_round('percent', 1)} as percentage_score,
  activities * 1.5::double + decisions * 2::double + forks * 1.5::double as functional_complexity,
  swimlanes * 2::double as organization_score,
  {sql_py_round('greatest(0::double, negative_score + 10)', 2)} as structural_integrity,
  {sql_py_round('decisions / greatest(activities, 1)', 3)} as decisions_activities_ratio
 from (select *, greatest(0::double, least(100::double, raw / ceiling * 100)) as percent from r)""",
)
F_ = (
    "f",
    """select * exclude (percent), concat(case when percent > 0 then printf('%.1f', percentage_score) else '0' end, '% (',
  regexp_replace(printf('%.2f', raw_score), '0$', ''), ')') as formatted_score from m""",
)
COUNTED = (D, L, E_, N, O, C, P, S)
SCORED = (*COUNTED, R, M, F_)
METRICS = ", ".join(cm.METRIC_COLUMNS)


def _metrics(spark, sf):
    return cm.code_metrics(views.diagrams(spark, sf))


def _metric_query(name, *columns, sql_columns=None, ctes=SCORED, source="f"):
    sql = with_(*ctes, select=f"select story_id, variant, {sql_columns or ', '.join(columns)} from {source}")

    @check(name, sql)
    def run(spark, sf):
        return _metrics(spark, sf).select("story_id", "variant", *columns)


for _number, _name in enumerate(
    ["numberline", "activities", "decisions", "forks", "swimlanes", "detaches", "options", "edges", "notes", "partitions"], 1
):
    _metric_query(f"code{_number}_{_name}", _name, ctes=(D, L, E_, N, O, C), source="c")
_metric_query("code18_penalty_total", "negative_score", ctes=COUNTED, source="s")
_metric_query("code20_raw_score", "raw_score")
_metric_query("code21_percentage", "percentage_score")
_metric_query("code22_formatted_score", "formatted_score")
_metric_query("code23_quality", "functional_complexity", "organization_score", "structural_integrity")
_metric_query("code24_decision_ratio", "decisions_activities_ratio")


@check("code26_metric_row", with_(*SCORED, select=f"select story_id, variant, model_group, {METRICS} from f"))
def metric_row(spark, sf):
    return _metrics(spark, sf).select("story_id", "variant", "model_group", *cm.METRIC_COLUMNS)


@check(
    "code25_lines_vs_average",
    with_(*COUNTED, select="select story_id, variant, numberline, coalesce("
          + sql_py_round("numberline / nullif((select avg(numberline) from s), 0)", 3) + ", 0::double) as lines_vs_average from s"),
)
def lines_vs_average(spark, sf):
    return cm.with_lines_vs_average(_metrics(spark, sf)).select("story_id", "variant", "numberline", "lines_vs_average")


# Records: each rule of the balance check as one SELECT.
_RECORDS = {
    "code11_if_gap": ("if_gap > 0", "'orphaned_activities'", "if_gap", "0",
                      "concat('Info: Potential if-endif imbalance of ', if_gap, ' treated as orphaned activities (no penalty)')"),
    "code12_fork_gap": ("fork_gap > 0", "'fork-join_imbalance'", "fork_gap", "-3 * fork_gap",
                        "concat('Unbalanced fork-join statements: ', forks, ' fork vs ', joins, ' join')"),
    "code13_switch_gap": ("switch_gap > 0", "'switch-endswitch_imbalance'", "switch_gap", "-3 * switch_gap",
                          "concat('Unbalanced switch-endswitch statements: ', switches, ' switch vs ', endswitches, ' endswitch')"),
    "code14_missing_start": ("starts = 0", "'missing_start'", "1", "-10",
                             "'CRITICAL: Missing start statement - essential for proper activity diagram flow'"),
    "code14_missing_stop": ("stops = 0", "'missing_stop'", "1", "-10",
                            "'CRITICAL: Missing stop/end statement - essential for proper activity diagram flow'"),
    "code15_line_ratio": ("pss is not null", "'pss'", sql_py_round("excess", 1), sql_py_round("pss", 1),
                          f"concat('Minor: Excessive lines ratio: ', printf('%.1f', {sql_py_round('ratio', 1)}), "
                          "' lines per activity (smart threshold: ', printf('%.1f', threshold), ')')"),
    "code17_orphans": ("orphans > 0", "'orphaned_activities'", "orphans", "0",
                       "concat('Info: Activities detected as potentially disconnected: ', orphans, ' (no penalty applied)')"),
}
_SELECTS = {
    name: f"select story_id, variant, {element} as element, ({count})::double as \"count\", ({score})::double as score, "
          f"{text} as explanation, code as original_code from s where {rule}"
    for name, (rule, element, count, score, text) in _RECORDS.items()
}
_TELLS = {
    "code11_if_gap": "Info: Potential if-endif", "code12_fork_gap": "Unbalanced fork", "code13_switch_gap": "Unbalanced switch",
    "code14_missing_start": "CRITICAL: Missing start", "code14_missing_stop": "CRITICAL: Missing stop",
    "code15_line_ratio": "Minor:", "code17_orphans": "Info: Activities detected",
}


def _record_query(name):
    @check(name, with_(*COUNTED, select=f"select * exclude (original_code) from ({_SELECTS[name]})"))
    def run(spark, sf):
        details = cm.penalty_details(_metrics(spark, sf))
        return details.filter(F.startswith("explanation", F.lit(_TELLS[name]))).select(
            "story_id", "variant", "element", "count", "score", "explanation"
        )


for _name in _RECORDS:
    _record_query(_name)


@check("code19_penalty_details", with_(*COUNTED, select="\nunion all ".join(_SELECTS.values())))
def penalty_details(spark, sf):
    return cm.penalty_details(_metrics(spark, sf)).select(
        "story_id", "variant", "element", "count", "score", "explanation", "original_code"
    )


@check(
    "code16_flow_elements",
    with_(D, L, E_, select="select story_id, variant, position::int as position, (position + 1)::int as line_number, type, line from e"),
)
def flow_elements(spark, sf):
    return cm.flow_elements(views.diagrams(spark, sf)).select(
        "story_id", "variant", "position", "line_number", "type", "line"
    )


_ELEVEN = [*cm.COUNTS, "negative_score"]


@check(
    "agg1_average_metrics",
    with_(*COUNTED, select="\nunion all ".join(
        f"select '{label}_{n}' as metric, {sql_np_round(f'{fn}({n})', 4)} as value from s"
        for n in _ELEVEN for label, fn in (("avg", "avg"), ("std", "stddev_pop"), ("median", "median")))),
)
def average_metrics(spark, sf):
    return cm.average_metrics(_metrics(spark, sf))


_SUMMED = [*_ELEVEN, *cm.SCORES]
_AVERAGED = {"raw_score": 2, "percentage_score": 1, "negative_score": 2, "functional_complexity": 2,
             "organization_score": 2, "structural_integrity": 2}
_TOTALS = (
    "g",
    "select variant, grouping(variant) as everything, count(*) as valid_entries, "
    + ", ".join(f"sum({n})::bigint as total_{n}" if n in cm.COUNTS else f"sum({n}::decimal(28, 10))::double as total_{n}" for n in _SUMMED)
    + f" from f where {sql_strip('code')} <> '' group by grouping sets ((variant), ())",
)
_TOTAL_SELECT = (
    "select case when everything = 1 then 'TOTAL' else variant end as column_name, "
    + ", ".join(f"total_{n}" for n in cm.COUNTS)
    + f", {sql_py_round('total_negative_score', 6)} as total_negative_score, "
    + sql_py_round("total_decisions / greatest(total_activities, 1)", 3) + " as decisions_activities_ratio, "
    + ", ".join(f"{sql_py_round(f'total_{n} / greatest(valid_entries, 1)', d)} as avg_{n}" for n, d in _AVERAGED.items())
    + ", valid_entries, "
    + ", ".join(f"case when everything = 1 then {sql_py_round(f'total_{n}', 6)} end as total_{n}" for n in cm.SCORES)
    + " from g"
)


@check("agg2_variant_totals", with_(*SCORED, _TOTALS, select=_TOTAL_SELECT))
def variant_totals(spark, sf):
    return cm.variant_totals(_metrics(spark, sf))


@check("agg3_grand_total", with_(*SCORED, _TOTALS, select=_TOTAL_SELECT + " where everything = 1"))
def grand_total(spark, sf):
    return cm.variant_totals(_metrics(spark, sf)).filter("column_name = 'TOTAL'")


@check(
    "flt2_valid_entries",
    with_(D, select=f"select variant, count(*) filter (where {sql_strip('code')} <> '') as valid_entries, count(*) as cells from d group by 1"),
)
def valid_entries(spark, sf):
    return cm.valid_entries(views.diagrams(spark, sf))
