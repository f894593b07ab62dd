"""The registered audit queries over whole test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglens.functions.numbers import unit
from dialoglens.functions.pii import EXTENDED, detected
from dialoglens.functions.text import evidence_sentences
from dialoglens.operators import retrieval, scoring, statistics, turns
from dialoglens.operators.row_draws import POISSON, ROWS, P
from dialoglens.plans import served
from dialoglens.sources import views
from dialoglens.sources.storage import kept, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; ``sql`` follows the common table expressions of ``views``."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH RECURSIVE {views.SQL.strip()}\n{sql.strip()}"
        return f

    return register


#: The mean of scores in whole billionths, as ``exact_mean``: the same bits in any order of rows.
EXACT = "sum(round(score * 1e9)::BIGINT)::DOUBLE / count(score) / 1e9"


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("SELECT call_id, turn_id, role, '[' || upper(role) || '] ' || content AS line FROM v_turns")
def turns_ingest(spark, sf_dir):
    return views.turns(spark, sf_dir).select("call_id", "turn_id", "role", F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.col("content")).alias("line"))


QA_SQL = """, marked AS (
  SELECT *, row_number() OVER w - 1 AS turn_index, coalesce((role <> lag(role) OVER w)::INT, 1) AS new FROM v_turns WINDOW w AS (PARTITION BY call_id ORDER BY turn_id)
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY turn_id) AS run FROM marked
), merged AS (
  SELECT call_id, run, role, trim(string_agg(content, ' ' ORDER BY turn_id)) AS said, max(turn_index) AS turn_index FROM numbered GROUP BY 1, 2, 3
), neighbours AS (
  SELECT *, lead(role) OVER w AS next_role, lead(said) OVER w AS answer FROM merged WINDOW w AS (PARTITION BY call_id ORDER BY run)
), v_qa AS (
  SELECT call_id, turn_index, said AS question, answer FROM neighbours WHERE role = 'user' AND next_role = 'bot' AND length(said) >= 4 AND length(answer) >= 4
    AND NOT (length(answer) < 20 AND (starts_with(answer, '안녕하세요') OR starts_with(answer, '감사합니다') OR starts_with(answer, '네,') OR starts_with(answer, '잠시만')))
)"""


def pairs_sql(text: str) -> str:
    """All pairs of neighbours: those that begin at odd places, then those at even ones."""
    return f"list_concat(regexp_extract_all({text}, '(?s)..'), regexp_extract_all(substr({text}, 2), '(?s)..'))"


def tokens_sql(text: str) -> str:
    compact = f"regexp_replace({text}, '\\s+', '', 'g')"
    return f"list_distinct(list_concat(regexp_extract_all(lower({text}), '[0-9A-Za-z가-힣]{{2,}}'), {pairs_sql(compact)}))"


@query(f"{QA_SQL} SELECT call_id, turn_index, question, answer FROM v_qa")
def qa_pairs(spark, sf_dir):
    return turns.question_answer_pairs(views.turns(spark, sf_dir)).select("call_id", "turn_index", "question", "answer")


@query("SELECT call_id, count(*) AS turn_count, count(*) FILTER (role = 'bot') AS bot_turns, count(*) FILTER (role = 'bot') > 1 AS is_multiturn, arg_max(content, turn_id) FILTER (role = 'bot') AS last_bot_answer FROM v_turns GROUP BY call_id")
def session_shape(spark, sf_dir):
    return turns.session_shape(views.turns(spark, sf_dir))


@query("SELECT call_id, turn_id, coalesce(string_agg(content, ' / ') OVER (PARTITION BY call_id ORDER BY turn_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context FROM v_turns")
def context_turns(spark, sf_dir):
    return turns.with_context(views.turns(spark, sf_dir)).select("call_id", "turn_id", F.array_join("context", " / ").alias("context"))


@query("SELECT call_id, string_agg('[' || upper(role) || '] ' || content, chr(10) ORDER BY turn_id) AS transcript FROM v_turns GROUP BY call_id")
def transcripts(spark, sf_dir):
    return turns.transcripts(views.turns(spark, sf_dir))


@query("""SELECT metric, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.9), 6) AS p90,
  count(*) FILTER (score < sla) AS below_sla_count, count(*) AS total_count, round(1 - count(*) FILTER (score < sla) / count(*), 6) AS sla_pass_rate FROM v_sla GROUP BY metric""")
def sla_summary(spark, sf_dir):
    return rounded(statistics.sla_summary(kept(views.scores(spark, sf_dir).select("metric", "score"), "scores")), "mean", "median", "p10", "p90", "sla_pass_rate")


@query(f"""SELECT CASE WHEN grouping(call_id) = 0 THEN 'call' WHEN grouping(tenant_id) = 0 THEN 'tenant' WHEN grouping(day) = 0 THEN 'day' ELSE 'all' END AS grouping,
  call_id, tenant_id, day, {EXACT} AS mean, count(*) AS n, sum((score < sla)::BIGINT)::BIGINT AS below
  FROM (SELECT s.*, e.call_id, e.tenant_id, e.evaluated_at::DATE AS day FROM v_sla s JOIN v_eval e USING (eval_id)) GROUP BY GROUPING SETS ((call_id), (tenant_id), (day), ())""")
def sla_group_by(spark, sf_dir):
    return statistics.by_group(views.scores(spark, sf_dir), views.evaluations(spark, sf_dir))


@query("SELECT DISTINCT call_id FROM v_eval JOIN v_sla USING (eval_id) WHERE score < sla")
def flagged_calls(spark, sf_dir):
    return statistics.flagged_calls(views.scores(spark, sf_dir), views.evaluations(spark, sf_dir))


@query("SELECT count(DISTINCT call_id) AS total_calls, count(*) AS total_evaluations, min(evaluated_at) AS period_start, max(evaluated_at) AS period_end FROM v_eval")
def run_period_totals(spark, sf_dir):
    return views.evaluations(spark, sf_dir).agg(F.countDistinct("call_id").alias("total_calls"), F.count(F.lit(1)).alias("total_evaluations"), F.min("evaluated_at").alias("period_start"), F.max("evaluated_at").alias("period_end"))


@query(""", p AS (SELECT eval_id, max(score) FILTER (metric = 'faithfulness') AS f, max(score) FILTER (metric = 'context_recall') AS r FROM v_scores GROUP BY eval_id
), d AS (SELECT CASE WHEN coalesce(f >= 0.8, true) AND coalesce(r >= 0.7, true) THEN 'healthy' WHEN coalesce(f >= 0.8, true) THEN 'retrieval_failure'
    WHEN coalesce(r >= 0.7, true) THEN 'generation_hallucination' ELSE 'both' END AS category FROM p)
SELECT c.category, count(d.category) AS n FROM (VALUES ('healthy'), ('retrieval_failure'), ('generation_hallucination'), ('both')) c(category) LEFT JOIN d ON c.category = d.category GROUP BY 1""")
def diagnosis_2x2(spark, sf_dir):
    return statistics.diagnosis_counts(views.scores(spark, sf_dir))


EVAL = "eval_id, call_id, tenant_id, run_id, review_status, level"
EVAL_COLUMNS = EVAL.split(", ")


@query(f"SELECT {EVAL} FROM v_eval WHERE eval_id IN (SELECT eval_id FROM v_scores WHERE metric = 'faithfulness' AND score < 0.8)")
def evals_below(spark, sf_dir):
    return served.below(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), "faithfulness", 0.8).select(EVAL_COLUMNS)


@query(f"SELECT {EVAL} FROM v_eval WHERE eval_id IN (SELECT eval_id FROM v_scores WHERE is_low_confidence)")
def evals_low_confidence(spark, sf_dir):
    return served.low_confidence(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)).select(EVAL_COLUMNS)


@query(f"SELECT {EVAL} FROM v_eval WHERE call_id IN (SELECT call_id FROM v_eval JOIN v_sla USING (eval_id) WHERE score < sla)")
def evals_flagged(spark, sf_dir):
    return served.flagged(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)).select(EVAL_COLUMNS)


@query(f"SELECT {EVAL} FROM v_eval ORDER BY call_id, eval_id LIMIT 1000 OFFSET 100")
def evals_page(spark, sf_dir):
    return served.page(views.evaluations(spark, sf_dir), 1000, 100).select(EVAL_COLUMNS)


@query(f"SELECT {EVAL} FROM v_eval WHERE level = 'turn' AND evaluated_at::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND eval_id IN (SELECT eval_id FROM v_scores WHERE metric = 'context_recall')")
def evals_filtered(spark, sf_dir):
    return served.filtered(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), level="turn", metric="context_recall", date_from="2024-01-05", date_to="2024-01-20").select(EVAL_COLUMNS)


@query(f"SELECT {EVAL} FROM v_eval e WHERE NOT EXISTS (SELECT 1 FROM v_scores s WHERE s.eval_id = e.eval_id AND s.metric = 'faithfulness')")
def resume_pending(spark, sf_dir):
    return served.resume(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir).where("metric = 'faithfulness'"), "eval_id").select(EVAL_COLUMNS)


def trend_sql(bucket: str) -> str:
    return f"SELECT tenant_id, {bucket} AS bucket, metric, {EXACT} AS avg_score, count(DISTINCT eval_id) AS n, min(evaluated_at) AS first_at FROM v_eval JOIN v_scores USING (eval_id) WHERE level = 'turn' GROUP BY 1, 2, 3"


@query(trend_sql("strftime(evaluated_at, '%Y-%m-%d')"))
def tenant_trends_day(spark, sf_dir):
    return served.trends(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), "day")


@query(trend_sql("run_id"))
def tenant_trends_run(spark, sf_dir):
    return served.trends(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), "run")


MEANS_SQL = f", means AS (SELECT run_id, metric, {EXACT} AS mean, count(*) AS n FROM v_eval JOIN v_scores USING (eval_id) GROUP BY 1, 2)"


@query(f"{MEANS_SQL} SELECT run_id, metric, mean, n FROM means")
def run_trends(spark, sf_dir):
    return served.run_means(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir))


@query(f"""{MEANS_SQL}, runs AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS before FROM (SELECT DISTINCT run_id FROM means))
SELECT m.run_id, m.metric, m.mean, p.mean AS previous, m.mean - p.mean AS delta, m.mean - p.mean < -0.05 AS is_regression
FROM means m JOIN runs r ON m.run_id = r.run_id JOIN means p ON p.run_id = r.before AND p.metric = m.metric""")
def previous_run_delta(spark, sf_dir):
    return served.run_deltas(served.run_means(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)))


@query("SELECT tenant_id, tenant_id::VARCHAR AS name, count(DISTINCT call_id) AS conversation_count, count(*) FILTER (level = 'turn' AND review_status = 'pending') AS pending_review_count FROM v_eval GROUP BY tenant_id")
def tenants(spark, sf_dir):
    return served.tenants(views.evaluations(spark, sf_dir))


@query("""SELECT call_id, tenant_id, count(*) FILTER (level = 'turn') AS n_turn_evals, count(*) FILTER (level = 'turn') > 1 AS is_multiturn,
  count(*) FILTER (level = 'turn' AND review_status = 'pending') AS pending, min(evaluated_at) AS started_at,
  (SELECT round(avg(score), 6) FROM v_eval x JOIN v_scores s USING (eval_id) WHERE x.level = 'session' AND x.call_id = e.call_id) AS session_score FROM v_eval e GROUP BY call_id, tenant_id""")
def conversation_list(spark, sf_dir):
    return rounded(served.conversations(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)), "session_score")


SAMPLES_SQL = """, samples AS (
  SELECT tenant_id, s.eval_id, s.metric, s.score AS auto_score, coalesce(r.human_score, s.score) AS human_score
  FROM v_eval e JOIN v_scores s USING (eval_id) LEFT JOIN v_reviews r ON r.eval_id = s.eval_id AND r.metric = s.metric WHERE review_status IN ('approved', 'overridden'))"""


@query(f"{SAMPLES_SQL} SELECT tenant_id, eval_id, metric, round(auto_score, 6) AS auto_score, round(human_score, 6) AS human_score, round(human_score - auto_score, 6) AS delta, abs(human_score - auto_score) < 0.13 AS agree FROM samples")
def agreement_samples(spark, sf_dir):
    return rounded(served.agreement_samples(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), views.reviews(spark, sf_dir)), "auto_score", "human_score", "delta")


@query(f"{SAMPLES_SQL} SELECT tenant_id, metric, count(*) AS n, round(avg(abs(human_score - auto_score)), 6) AS mae, round(avg((abs(human_score - auto_score) < 0.13)::INT), 6) AS agreement FROM samples GROUP BY GROUPING SETS ((tenant_id, metric), (tenant_id))")
def agreement(spark, sf_dir):
    samples = served.agreement_samples(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), views.reviews(spark, sf_dir))
    return rounded(served.agreement(samples), "mae", "agreement")


@query("""SELECT coalesce(s.eval_id, r.eval_id) AS eval_id, coalesce(s.metric, r.metric) AS metric, round(s.score, 6) AS auto_score, round(r.human_score, 6) AS human_score,
  round(coalesce(r.human_score, s.score), 6) AS final_score FROM v_scores s FULL JOIN v_reviews r ON s.eval_id = r.eval_id AND s.metric = r.metric""")
def final_scores(spark, sf_dir):
    return rounded(served.final_scores(views.scores(spark, sf_dir), views.reviews(spark, sf_dir)), "auto_score", "human_score", "final_score")


@query("""SELECT tenant_id, count(DISTINCT call_id) AS sources, max(evaluated_at) AS last_indexed_at, round(coalesce(avg(score), 0), 6) AS avg_recall, count(*) FILTER (score < 0.7) AS n_gaps
  FROM v_eval e LEFT JOIN (SELECT * FROM v_scores WHERE metric = 'context_recall') s ON e.eval_id = s.eval_id WHERE level = 'turn' GROUP BY tenant_id""")
def kb_status(spark, sf_dir):
    return rounded(served.knowledge_base(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)), "avg_recall")


@query("""SELECT tenant_id, row_number() OVER w AS place, e.eval_id, call_id, round(score, 6) AS recall FROM v_eval e JOIN v_scores s ON e.eval_id = s.eval_id
  WHERE metric = 'context_recall' AND score < 0.7 AND level = 'turn' WINDOW w AS (PARTITION BY tenant_id ORDER BY score, e.eval_id) QUALIFY place <= 10""")
def coverage_gaps(spark, sf_dir):
    return rounded(served.coverage_gaps(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)), "recall")


@query("""SELECT e.eval_id, level, round(min(confidence), 6) AS min_confidence, round(min(score), 6) AS min_score FROM v_eval e LEFT JOIN v_scores s ON e.eval_id = s.eval_id
  WHERE review_status = 'pending' GROUP BY 1, 2 ORDER BY min(confidence) NULLS FIRST, e.eval_id LIMIT 50""")
def review_queue(spark, sf_dir):
    return rounded(served.review_queue(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)), "min_confidence", "min_score")


@query(""", thr AS (SELECT *, CASE metric WHEN 'faithfulness' THEN 0.8 WHEN 'answer_relevance' THEN 0.75 WHEN 'context_precision' THEN 0.7 WHEN 'context_recall' THEN 0.7 END::DOUBLE AS t FROM v_scores)
SELECT eval_id, round(sum(1 - confidence + CASE WHEN is_low_confidence THEN 0.5 ELSE 0 END + CASE WHEN abs(score - t) < 0.1::DOUBLE THEN (0.1::DOUBLE - abs(score - t)) * 10 ELSE 0 END) / count(*), 6) AS priority FROM thr GROUP BY eval_id""")
def review_priority(spark, sf_dir):
    return rounded(statistics.review_priority(views.scores(spark, sf_dir)), "priority")


@query(""", p AS (SELECT least(1.0, n_chars / 3000.0)::DOUBLE AS judge, quality::DOUBLE AS human FROM labels JOIN documents USING (doc_id)
), r AS (SELECT judge, human, rank() OVER (ORDER BY judge) + (count(*) OVER (PARTITION BY judge) - 1) / 2 AS rj, rank() OVER (ORDER BY human) + (count(*) OVER (PARTITION BY human) - 1) / 2 AS rh,
    least(4, greatest(0, round_even(judge * 4, 0)))::INT AS bj, least(4, greatest(0, round_even(human * 4, 0)))::INT AS bh FROM p
), k AS (SELECT count(*) AS n, avg(abs(judge - human)) AS mae, coalesce(corr(rj, rh), 0) AS spearman, avg((bj = bh)::INT) AS po FROM r
), e AS (SELECT sum(a.c * b.c)::DOUBLE / (SELECT n * n FROM k) AS pe FROM (SELECT bj, count(*) AS c FROM r GROUP BY bj) a JOIN (SELECT bh, count(*) AS c FROM r GROUP BY bh) b ON a.bj = b.bh)
SELECT n, round(mae, 6) AS mae, round(spearman, 6) AS spearman, round(CASE WHEN coalesce(pe, 0) < 1 THEN (po - coalesce(pe, 0)) / (1 - coalesce(pe, 0)) ELSE 1 END, 6) AS kappa FROM k, e""")
def meta_eval(spark, sf_dir):
    judged = views.table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 3000.0).alias("judge"))
    pairs = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("human")).join(judged, "doc_id")
    return rounded(statistics.meta_evaluation(pairs), "mae", "spearman", "kappa")


REPLICATES = 1000


def unit_sql(start: int) -> str:
    return f"(('0x' || substr(h, {start}, 15))::BIGINT::DOUBLE / 1152921504606846976)"


NORMAL_SQL = f"(sqrt(-2 * ln(1 - {unit_sql(1)})) * cos(2 * pi() * {unit_sql(17)}))"


def inverted_sql(first: str, ratio: str, most: str) -> str:
    """The least k whose summed probabilities pass the draw; ``ratio`` leads from ``a.k`` to the next."""
    return f"""list_reduce(list_prepend({{'k': 0::DOUBLE, 'p': {first}, 't': {first}}}, list_transform(range(0, ({most})::BIGINT), lambda i: {{'k': i::DOUBLE, 'p': 0::DOUBLE, 't': 0::DOUBLE}})),
      lambda a, x: CASE WHEN {unit_sql(1)} >= a.t AND a.k = x.k THEN {{'k': a.k + 1, 'p': a.p * ({ratio}), 't': a.t + a.p * ({ratio})}} ELSE a END).k"""


BINOMIAL = f"""CASE WHEN c >= n THEN m WHEN m * (c / n) * (1 - c / n) > 50 THEN greatest(0, least(m, round(m * (c / n) + sqrt(m * (c / n) * (1 - c / n)) * {NORMAL_SQL}))) WHEN c / n > 1 - c / n THEN m - k0 ELSE k0 END"""
B0 = inverted_sql("pow(1 - p, m)", "((m - a.k) * p) / ((a.k + 1) * (1 - p))", "CASE WHEN m * (c / n) * (1 - c / n) > 50 THEN 0 ELSE least(m, ceil(m * p + 12 * sqrt(m * p) + 30)) END")

def binned_sql(values: str) -> str:
    """``spans`` and ``bins`` of ``values``: a SELECT of ``metric, score, now``."""
    return f""", vals AS MATERIALIZED (SELECT * FROM ({values}) WHERE score IS NOT NULL
), spans AS (SELECT metric, min(score) AS low, max(score) AS high, count(DISTINCT score) AS d, count(*) AS n, sum(now) AS nc FROM vals GROUP BY 1
), bins AS MATERIALIZED (SELECT metric, c::DOUBLE AS c, mean, row_number() OVER (PARTITION BY metric ORDER BY b) - 1 AS j FROM (
  SELECT v.metric, CASE WHEN d <= 128 THEN score ELSE least(127, floor((score - low) / (high - low) * 128)) END AS b, count(*) AS c, avg(score) AS mean FROM vals v JOIN spans s ON v.metric = s.metric GROUP BY 1, 2))"""


def chain_sql(size: str, k: str, where: str = "true") -> str:
    """``reps``: each replicate's number of rows and their sum, bin after bin."""
    return f""", chain AS (SELECT metric, rep, 0::BIGINT AS j, n::DOUBLE AS n, ({size})::DOUBLE AS m, 0::DOUBLE AS total FROM spans s, range(0, {REPLICATES}) t(rep) WHERE {where}
  UNION ALL SELECT metric, rep, j + 1, n - c, m - k, total + k * mean FROM ({k})
), reps AS (SELECT c.metric, rep, ({size})::DOUBLE AS n, total FROM chain c JOIN (SELECT metric, max(j) + 1 AS last FROM bins GROUP BY 1) e ON c.metric = e.metric AND c.j = e.last JOIN spans s ON s.metric = c.metric)"""


STEP = f"SELECT c.*, b.c, b.mean, md5(concat_ws('|', '42', rep, c.metric, c.j)) AS h FROM chain c JOIN bins b ON b.metric = c.metric AND b.j = c.j"
MULTINOMIAL_SQL = chain_sql("s.n", f"SELECT *, {BINOMIAL} AS k FROM (SELECT *, {B0} AS k0 FROM (SELECT *, least(c / n, 1 - c / n) AS p FROM ({STEP})))")
CI_SQL = f""", bounds AS (SELECT metric, list_sort(list(total / nullif(n, 0))) AS all_m FROM reps GROUP BY 1
), ci AS (SELECT v.metric, avg(v.score) AS mean, count(*) AS n, any_value(all_m)[{int(0.025 * REPLICATES + 1e-9) + 1}] AS low, any_value(all_m)[{int(0.975 * REPLICATES + 1e-9) + 1}] AS high FROM vals v JOIN bounds b ON v.metric = b.metric GROUP BY 1)"""


def seeds_sql(columns: str, of: str) -> str:
    """Rows of ``of`` with the whole numbers ``a`` and ``s`` of the stream that ``columns`` name."""
    return f"(SELECT *, 1 + ('0x' || substr(h, 1, 15))::BIGINT % {P - 1} AS a, ('0x' || substr(h, 17, 15))::BIGINT % {P} AS s FROM (SELECT *, md5(concat_ws('|', '42', {columns})) AS h FROM {of}))"


def fifth_sql(x: str) -> str:
    return f"((({x} * {x}) % {P}) * (({x} * {x}) % {P})) % {P} * {x} % {P}"


def drawn_sql(x: str, of: str) -> str:
    """Rows of ``of`` with their draw ``u``, a whole number below ``P``."""
    return f"(SELECT *, {fifth_sql('y')} AS u FROM (SELECT *, ({fifth_sql('x')} + a) % {P} AS y FROM (SELECT *, ({x}) % {P} AS x FROM {of})))"


def rows_sql(values: str, names: str) -> str:
    """``vals``: rows of a SELECT with two whole numbers each."""
    return f""", vals AS MATERIALIZED (SELECT *, ('0x' || substr(rh, 1, 15))::BIGINT % {P} AS r1, ('0x' || substr(rh, 17, 15))::BIGINT % {P} AS r2
  FROM (SELECT *, md5(concat_ws('|', {names})) AS rh FROM ({values}) WHERE score IS NOT NULL AND metric IS NOT NULL))"""


REPS = f"range(0, {REPLICATES}) t(rep)"
POISSON_SQL = f""", seeds AS MATERIALIZED (SELECT * FROM {seeds_sql("'poisson', rep", REPS)}
), reps AS (SELECT metric, rep, sum(w) AS n, sum(w * score) AS total FROM (SELECT metric, rep, score, {" + ".join(f"(u >= {c})::INT" for c in POISSON)} AS w FROM {drawn_sql("r1 * a + r2 + s", "(SELECT metric, score, r1, r2, rep, a, s FROM vals, seeds)")}) GROUP BY 1, 2)"""
ROWS_SQL = f""", ix AS MATERIALIZED (SELECT metric, score, row_number() OVER (PARTITION BY metric ORDER BY eval_id) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM vals
), seeds AS MATERIALIZED (SELECT * FROM {seeds_sql("'block', rep, metric", f"(SELECT DISTINCT metric FROM vals), {REPS}")}
), blocks AS MATERIALIZED (SELECT metric, rep, n, (u * n // {P}) // {ROWS} AS b, count(*) AS m FROM {drawn_sql("i * a + s", "(SELECT ix.metric, i, n, rep, a, s FROM ix JOIN seeds ON seeds.metric = ix.metric)")} GROUP BY 1, 2, 3, 4
), picks AS (SELECT metric, rep, b * {ROWS} + u * least({ROWS}, n - b * {ROWS}) // {P} AS i FROM {drawn_sql("t * a + s", f"(SELECT metric, rep, n, b, a, s, unnest(range(0, m)) AS t FROM {seeds_sql(chr(39) + 'row' + chr(39) + ', rep, metric, b', 'blocks')})")}
), reps AS (SELECT p.metric, rep, count(*) AS n, sum(score) AS total FROM picks p JOIN ix ON ix.metric = p.metric AND ix.i = p.i GROUP BY 1, 2)"""
ALL_SCORES = rows_sql("SELECT eval_id, metric, score FROM v_scores", "eval_id, metric")


@query(f"{ALL_SCORES}{ROWS_SQL}{CI_SQL} SELECT metric, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, n FROM ci")
def bootstrap_ci(spark, sf_dir):
    return rounded(statistics.bootstrap_ci(views.scores(spark, sf_dir), samples=REPLICATES), "mean", "low", "high")


@query(f"{ALL_SCORES}{POISSON_SQL}{CI_SQL} SELECT metric, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, n FROM ci")
def bootstrap_poisson(spark, sf_dir):
    return rounded(statistics.poisson_ci(views.scores(spark, sf_dir), samples=REPLICATES), "mean", "low", "high")


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Scores of the second and of the first half of the month."""
    ev = views.evaluations(spark, sf_dir).select("eval_id", (F.dayofmonth("evaluated_at") > 15).alias("late"))
    rows = views.scores(spark, sf_dir).join(ev, "eval_id")
    return rows.where("late"), rows.where("not late")


HALVES = "SELECT s.eval_id, s.metric, s.score, (day(e.evaluated_at) > 15)::INT AS now FROM v_scores s JOIN v_eval e USING (eval_id)"


@query(f"""{rows_sql(HALVES, "now, eval_id, metric")}
, o AS (SELECT metric, nc, n - nc AS np, total, sc, sc / nc - (total - sc) / (n - nc) AS delta FROM (SELECT metric, count(*) AS n, sum(now) AS nc, sum(score) AS total, sum(score * now) AS sc FROM vals GROUP BY 1) WHERE nc > 0 AND n > nc
), seeds AS MATERIALIZED (SELECT * FROM {seeds_sql("'shuffle', rep", REPS)}
), placed AS (SELECT metric, rep, score, row_number() OVER (PARTITION BY metric, rep ORDER BY u, now, eval_id) AS place FROM {drawn_sql("r1 * a + r2 + s", "(SELECT eval_id, metric, score, now, r1, r2, rep, a, s FROM vals, seeds)")}
), reps AS (SELECT p.metric, rep, sum(score) AS total FROM placed p JOIN o ON o.metric = p.metric WHERE place <= nc GROUP BY 1, 2
), tried AS (SELECT o.metric, any_value(delta) AS delta, (count(*) FILTER (abs(r.total / nc - (o.total - r.total) / np) >= abs(delta) - 1e-12) + 1) / {REPLICATES + 1} AS p FROM reps r JOIN o ON r.metric = o.metric GROUP BY 1)
SELECT metric, round(delta, 6) AS delta, round(p, 6) AS p_value, p < 0.05 AS significant, p < 0.05 AND delta < 0 AS is_regression FROM tried""")
def permutation_test(spark, sf_dir):
    return rounded(statistics.significant_regressions(*halves(spark, sf_dir), permutations=REPLICATES), "delta", "p_value")


LABELLED = rows_sql("SELECT eval_id, 'all' AS metric, confidence - score AS score FROM v_scores WHERE metric = 'faithfulness'", "eval_id, metric")


@query(f"""{LABELLED}{ROWS_SQL}{CI_SQL}, c AS (SELECT avg(score) AS naive, count(*) AS n_total FROM v_scores)
SELECT round(naive + mean, 6) AS point, round(naive + low, 6) AS ci_low, round(naive + high, 6) AS ci_high, n AS n_labelled, n_total, round(naive, 6) AS naive FROM ci, c""")
def ppi_mean(spark, sf_dir):
    scores = views.scores(spark, sf_dir)
    labelled = scores.where("metric = 'faithfulness'").select("eval_id", F.col("score").alias("classifier"), F.col("confidence").alias("judge"))
    out = statistics.ppi_mean(scores.select("eval_id", F.col("score").alias("classifier")), labelled, samples=REPLICATES)
    return rounded(out, "point", "ci_low", "ci_high", "naive")


@query(""", s AS (SELECT eval_id, median(score) AS score, coalesce(stddev_pop(score), 0) AS std, count(*) AS n_samples, list({'s': score, 'e': event_id}) AS l FROM v_events GROUP BY 1)
SELECT eval_id, round(score, 6) AS score, round(greatest(0, 1 - std / 0.5), 6) AS confidence, std > 0.2 AS is_low_confidence, n_samples FROM s""")
def sample_collapse(spark, sf_dir):
    samples = views.with_eval(spark, sf_dir).select("eval_id", F.col("event_id").alias("sample"), "score", F.lit("read").alias("reasoning"))
    return rounded(scoring.collapsed(samples, "eval_id"), "score", "confidence").drop("reasoning")


@query("""SELECT eval_id, round(avg(score), 6) AS score, round(greatest(0, 1 - coalesce(stddev_pop(score), 0) / 0.5), 6) AS confidence, coalesce(stddev_pop(score), 0) > 0.25 AS is_low_confidence, count(*) AS n_providers FROM v_events GROUP BY 1""")
def ensemble_scores(spark, sf_dir):
    judged = views.with_eval(spark, sf_dir).select("eval_id", F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("provider"), "score", F.col("event_id").alias("place"))
    out = scoring.ensembles(judged, "eval_id").select("eval_id", "score", "confidence", "is_low_confidence", F.size("by_provider").cast("long").alias("n_providers"))
    return rounded(out, "score", "confidence")


@query(f"""{QA_SQL}, tk AS (SELECT call_id, turn_index, {tokens_sql("question")} AS q, {tokens_sql("answer")} AS a FROM v_qa)
SELECT call_id, turn_index, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, q)) / len(a) END, 6) AS answer_relevance FROM tk""")
def token_overlap(spark, sf_dir):
    pairs = turns.question_answer_pairs(views.turns(spark, sf_dir))
    found = scoring.overlap_scores(pairs).where("metric = 'answer_relevance'").select("qa_id", F.col("score").alias("answer_relevance"))
    return rounded(pairs.select("qa_id", "call_id", "turn_index").join(found, "qa_id").drop("qa_id"), "answer_relevance")


@query("""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') AS has_email, regexp_matches(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}') AS has_ipv4, regexp_matches(text, '[0-9]{16}') AS has_card FROM documents""")
def pii_scan(spark, sf_dir):
    found = detected(views.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", patterns=EXTENDED)
    return found.select("doc_id", *(F.array_contains("pii", n).alias(c) for n, c in (("email", "has_email"), ("ipv4", "has_ipv4"), ("card_plain", "has_card"))))


def mod_100_sql(key: str) -> str:
    out = "0"
    for start in (1, 9, 17, 25):
        out = f"(({out} * 96 + ('0x' || substr(md5({key}), {start}, 8))::BIGINT) % 100)"
    return out


@query(f"""SELECT call_id, turn_id, {mod_100_sql("call_id || '|' || turn_id")} < 20 AS labelled FROM v_turns""")
def ppi_split(spark, sf_dir):
    rows = views.turns(spark, sf_dir).select("call_id", "turn_id", F.concat_ws("|", F.col("call_id").cast("string"), F.col("turn_id").cast("string")).alias("qa_id"))
    return scoring.labelled_share(rows, 0.2).select("call_id", "turn_id", "labelled")


EMBED_SQL = """SELECT id, ('0x' || substr(md5(token), 31, 2))::BIGINT % 64 AS bucket, count(*) AS n FROM (SELECT {id} AS id, unnest(CASE WHEN len({t}) > 0 THEN {t} ELSE [{text}] END) AS token FROM {rel}) GROUP BY 1, 2"""


@query(f""", c AS ({EMBED_SQL.format(id="call_id * 1000 + turn_id", t=tokens_sql("content"), text="content", rel="v_turns")})
SELECT id AS turn_key, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS value FROM c""")
def hashed_embedding(spark, sf_dir):
    rows = views.turns(spark, sf_dir).select((F.col("call_id") * 1000 + F.col("turn_id")).alias("turn_key"), "content")
    return rounded(retrieval.hashed_embeddings(rows, "turn_key", "content"), "value")


@query(""", v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM v q, v d WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) - 1 AS rank FROM s QUALIFY rank < 20""")
def dense_topk(spark, sf_dir):
    # each block of queries reads the vectors, so they are made once
    v = kept(spread(views.table(spark, sf_dir, "embeddings").select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("v"))), "vectors")
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    return rounded(retrieval.vector_search(queries, v, 20), "score")


@query(""", w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents
), p AS (SELECT doc_id, st // 950 AS p, ws[st + 1 : st + 1000] AS pw FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 950)) AS st FROM w) WHERE st = 0 OR st + 50 < len(ws)
), c AS (SELECT doc_id, p, st // 150 AS c, pw[st + 1 : st + 200] AS cw FROM (SELECT doc_id, p, pw, unnest(range(0, len(pw), 150)) AS st FROM p) WHERE st = 0 OR st + 50 < len(pw))
SELECT doc_id AS source_id, 'parent' AS level, array_to_string(pw, ' ') AS content, len(pw)::INT AS token_count FROM p UNION ALL SELECT doc_id, 'child', array_to_string(cw, ' '), len(cw)::INT FROM c""")
def word_chunks(spark, sf_dir):
    return retrieval.chunked(views.table(spark, sf_dir, "documents"), "doc_id", "text").select("source_id", "level", "content", "token_count")


TERMS_SQL = "list_concat(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda x: x <> ''), list_filter(" + pairs_sql("{t}") + ", lambda x: NOT regexp_matches(x, '^\\s*$')))"
BM25_SQL = f""", dt AS (SELECT doc_id, {TERMS_SQL.format(t="text")} AS ts FROM documents
), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM dt
), qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS_SQL.format(t="text")}) AS term FROM benchmark) GROUP BY 1, 2
), post AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS size, unnest(ts) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3
), idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM post, st GROUP BY term, n
), bs AS (SELECT item_id, doc_id, round(sum(times * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(size, 1) / mean))), 9) AS score FROM post JOIN qt USING (term) JOIN idf USING (term), st GROUP BY 1, 2
), bm AS (SELECT item_id AS query_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bs WHERE score > 0 QUALIFY rank < 20)"""


def corpus(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The benchmark's passages as queries, all documents as chunks."""
    queries = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return queries, views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


@query(f"{BM25_SQL} SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark, sf_dir):
    return rounded(retrieval.bm25_search(*corpus(spark, sf_dir), 20), "score")


HASHED_SQL = f""", qc AS ({EMBED_SQL.format(id="item_id", t=tokens_sql("text"), text="text", rel="benchmark")}
), dc AS ({EMBED_SQL.format(id="doc_id", t=tokens_sql("coalesce(text, '')"), text="coalesce(text, '')", rel="documents")}
), hs AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.n * d.n)::DOUBLE AS dots FROM qc q JOIN dc d ON q.bucket = d.bucket GROUP BY 1, 2
), hd AS (SELECT hs.query_id, hs.doc_id, round(dots / sqrt(qn.s * dn.s), 9) AS score FROM hs JOIN (SELECT id, sum(n * n)::DOUBLE AS s FROM qc GROUP BY 1) qn ON qn.id = hs.query_id
  JOIN (SELECT id, sum(n * n)::DOUBLE AS s FROM dc GROUP BY 1) dn ON dn.id = hs.doc_id
), hk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) - 1 AS rank FROM hd QUALIFY rank < 20
), fu AS (SELECT query_id, doc_id, round(sum(part), 12) AS score FROM (SELECT query_id, doc_id, 0.7::DOUBLE / (60 + rank) AS part FROM hk UNION ALL SELECT query_id, doc_id, 0.3::DOUBLE / (60 + rank) FROM bm) GROUP BY 1, 2
), fk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM fu QUALIFY rank < 20)"""


@query(f"{BM25_SQL}{HASHED_SQL} SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, rank FROM fk")
def rrf_fusion(spark, sf_dir):
    queries, chunks = corpus(spark, sf_dir)
    found = retrieval.fused(retrieval.hashed_search(queries, chunks, 20), retrieval.bm25_search(queries, chunks, 20), 20)
    return rounded(found.select("query_id", "chunk_id", "score", "rank"), "score")


@query(f"""{BM25_SQL}{HASHED_SQL}, pr AS (SELECT f.query_id, f.doc_id, f.rank, list_distinct({TERMS_SQL.format(t="b.text")}) AS q, list_distinct({TERMS_SQL.format(t="d.text")}) AS c FROM fk f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.doc_id
), sc AS (SELECT query_id, doc_id, rank, len(list_intersect(q, c)) / len(q) AS score FROM pr)
SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) - 1 AS place FROM sc QUALIFY place < 5""")
def rerank_overlap(spark, sf_dir):
    queries, chunks = corpus(spark, sf_dir)
    return rounded(retrieval.hybrid_search(queries, chunks).withColumnRenamed("rank", "place"), "score")


@query("""SELECT call_id, turn_id, len(list_filter(regexp_split_to_array(regexp_replace(content, '([.!?。])\\s+', '\\1' || chr(10), 'g'), chr(10) || '+'), lambda x: trim(x) <> '')) AS n_sentences FROM v_turns""")
def evidence_sentence_counts(spark, sf_dir):
    return views.turns(spark, sf_dir).select("call_id", "turn_id", F.size(evidence_sentences(F.col("content"))).cast("long").alias("n_sentences"))


@query("""SELECT run_id, count(*) AS n_evaluations, count(DISTINCT call_id) AS n_calls, min(evaluated_at) AS started_at, run_id = (SELECT max(run_id) FROM v_eval) AS is_latest FROM v_eval GROUP BY run_id""")
def run_list(spark, sf_dir):
    return served.runs(views.evaluations(spark, sf_dir))


@query(f"SELECT {EVAL}, evaluated_at, row_number() OVER (PARTITION BY tenant_id ORDER BY evaluated_at DESC, eval_id) AS place FROM v_eval QUALIFY place <= 25")
def tenant_page(spark, sf_dir):
    return served.latest_of_tenants(views.evaluations(spark, sf_dir), 25).select(*EVAL_COLUMNS, "evaluated_at", "place")


@query("SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY turn_id) AS place, role, content FROM v_turns")
def conversation_turns(spark, sf_dir):
    return turns.in_order(views.turns(spark, sf_dir)).select("call_id", "place", "role", "content")


DIAGNOSED_SQL = """, p AS (SELECT eval_id, coalesce(max(score) FILTER (metric = 'faithfulness') >= 0.8, true) AS f, coalesce(max(score) FILTER (metric = 'context_recall') >= 0.7, true) AS r FROM v_scores GROUP BY eval_id)"""


@query(f"{DIAGNOSED_SQL} SELECT {EVAL} FROM v_eval JOIN p USING (eval_id) WHERE f AND NOT r")
def evals_by_diagnosis(spark, sf_dir):
    return served.with_diagnosis(views.evaluations(spark, sf_dir), views.scores(spark, sf_dir), "retrieval_failure").select(EVAL_COLUMNS)


@query(f"SELECT {EVAL} FROM v_eval WHERE (run_id, call_id) IN (SELECT e.run_id, e.call_id FROM v_eval e JOIN v_sla s USING (eval_id) WHERE score < sla)")
def evals_flagged_by_run(spark, sf_dir):
    ev, scores = views.evaluations(spark, sf_dir), views.scores(spark, sf_dir)
    low = scores.where(statistics.below_sla()).join(ev, "eval_id").groupBy("run_id").agg(F.to_json(F.collect_set(F.col("call_id").cast("string"))).alias("flagged_json"))
    return served.flagged_by_summary(ev, low).select(EVAL_COLUMNS)


@query("""SELECT call_id, unnest(['resolution', 'efficiency', 'escalation_handling']) AS metric,
  unnest([coalesce(r, resolved::INT::DOUBLE), coalesce(e, 1), CASE WHEN needed THEN 0 ELSE 1 END::DOUBLE]) AS score
  FROM (SELECT call_id, bool_or(review_status = 'approved') AS resolved, NULL::DOUBLE AS r, CASE WHEN count(*) > 12 THEN 0.5 END::DOUBLE AS e, bool_or(review_status = 'skipped') AS needed FROM v_eval GROUP BY call_id)""")
def session_scores(spark, sf_dir):
    by = views.evaluations(spark, sf_dir).groupBy("call_id").agg(
        F.bool_or(F.col("review_status") == "approved").alias("resolved"), F.lit(None).cast("double").alias("resolution_score"),
        F.when(F.count(F.lit(1)) > 12, 0.5).alias("efficiency_score"), F.bool_or(F.col("review_status") == "skipped").alias("escalation_needed"))
    return scoring.session_scores(by)


@query("""SELECT eval_id, count(*) FILTER (score >= 0.6) / count(*) AS score, count(*) AS n_claims, count(*) FILTER (score < 0.3) AS n_contradicted,
  count(*) FILTER (score >= 0.3 AND score < 0.6) AS n_unsupported FROM v_scores WHERE metric IS NOT NULL GROUP BY eval_id""")
def claim_scores(spark, sf_dir):
    """Each evaluation's metrics as claims, and verdicts from their scores; what is said in between has no verdict."""
    rows = views.scores(spark, sf_dir).where("metric is not null")
    claims = rows.groupBy("eval_id").agg(F.collect_list("metric").alias("claims"))
    verdict = F.when(F.col("score") >= 0.6, "supported").when(F.col("score") < 0.3, "contradicted").otherwise("unclear")
    return scoring.claim_faithfulness(claims, rows.select("eval_id", F.concat(F.lit(" "), "metric").alias("claim"), verdict.alias("verdict"), F.lit(0).alias("place")), "eval_id")


@query("SELECT eval_id, count(*) FILTER (score >= 0.5) / count(*) AS score, count(*) AS n_nuggets, count(*) FILTER (score >= 0.5) AS n_found FROM v_scores WHERE metric IS NOT NULL GROUP BY eval_id")
def nugget_scores(spark, sf_dir):
    rows = views.scores(spark, sf_dir).where("metric is not null")
    nuggets = rows.groupBy("eval_id").agg(F.collect_list("metric").alias("nuggets"))
    return scoring.nugget_recall(nuggets, rows.select("eval_id", F.col("metric").alias("nugget"), (F.col("score") >= 0.5).alias("found"), F.lit(0).alias("place")), "eval_id")


@query("SELECT call_id, CASE WHEN n < 2 THEN 1 ELSE (call_id % 3 <> 0)::INT END::DOUBLE AS score FROM (SELECT call_id, count(*) FILTER (role = 'bot') AS n FROM v_turns GROUP BY call_id)")
def consistency_scores(spark, sf_dir):
    answers = turns.session_shape(views.turns(spark, sf_dir)).select("call_id", F.col("bot_turns").alias("n_answers"))
    judged = answers.select("call_id", F.lit(None).cast("double").alias("score"), (F.col("call_id") % 3 != 0).alias("consistent"))
    return scoring.consistency(answers, judged)
