"""Queries on labels, texts, backfill, splits and annotation logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterloom.functions import labels as L
from chatterloom.functions import text as T
from chatterloom.operators import agreement as agreement_ops
from chatterloom.operators import annotation as A
from chatterloom.operators import backfill, prompting, sampling
from chatterloom.plans.dynamics import split_sql
from chatterloom.plans.training import MEGA, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


BLANK = "[\\s\\x{A0}\\x{2005}\\x{2007}\\x{2009}\\x{202F}]"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def tokens_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '[,+]'), lambda x: {trim_sql('x')}), lambda x: x <> '' AND regexp_replace(lower(x), '\\s', '', 'g') <> 'link/url')"


def bucket_sql(x: str, rules: str, exact: bool = True) -> str:
    pairs = L.rules(rules)
    own = f"{x} IN ({', '.join(q(n) for n, _ in pairs)})" if exact else "false"
    cases = " ".join(f"WHEN regexp_matches(lower({x}), {q(p)}) THEN {q(n)}" for n, p in pairs[:-1] if p and "^\\s" not in p.replace("[", ""))
    return f"CASE WHEN {own} THEN {x} {cases} ELSE {q(pairs[-1][0])} END"


def list_sql(field: str, rules: str, drop: str | None = None, exact: bool = True) -> str:
    tokens = tokens_sql(field)
    if drop:
        tokens = f"list_filter({tokens}, lambda x: NOT regexp_matches(lower(x), {q(drop)}))"
    return f"list_transform({tokens}, lambda x: {bucket_sql('x', rules, exact)})"


def ordered(x: str) -> str:
    """Distinct items in order of first place."""
    return f"list_filter({x}, lambda item, i: list_position({x}, item) = i)"


THEME = f"CASE WHEN {trim_sql('theme')} <> '' THEN {bucket_sql(trim_sql('theme'), L.THEME_RULES)} END"


@query(f"SELECT message_id, {THEME} AS theme_bucket FROM {MEGA}")
def norm_theme(spark, sf_dir):
    return table(spark, sf_dir, MEGA).select("message_id", L.norm_theme(F.col("theme")).alias("theme_bucket"))


@query(f"SELECT theme_bucket, count(*) AS n FROM (SELECT {THEME} AS theme_bucket FROM (SELECT replace(replace(replace(theme, '–', '-'), '—', '-'), '‑', '-') AS theme FROM {MEGA})) GROUP BY 1")
def theme_counts_folded(spark, sf_dir):
    return table(spark, sf_dir, MEGA).groupBy(L.norm_theme(F.col("theme"), fold_dashes=True).alias("theme_bucket")).agg(F.count("*").alias("n"))


def _labels(name, field, rules, drop=None, exact=True):
    x = list_sql(field, rules, drop, exact)
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, MEGA).select("message_id", F.array_join(L.norm_labels(F.col(field), rules, drop, exact), "|").alias("labels"))
    ORACLE[name] = f"SELECT message_id, coalesce(array_to_string({ordered('v')}, '|'), '') AS labels FROM (SELECT message_id, {x} AS v FROM {MEGA})"


_labels("norm_claims", "claim_types", L.CLAIM_RULES)
_labels("norm_claims_ablation", "claim_types", L.CLAIM_RULES_ABLATION)
_labels("norm_ctas", "ctas", L.CTA_RULES)
_labels("norm_evidence", "evidence", L.EVIDENCE_RULES, "link|url")
_labels("norm_claims_reduced", "claim_types", L.CLAIM_RULES_REDUCED, exact=False)
_labels("norm_ctas_reduced", "ctas", L.CTA_RULES_REDUCED, exact=False)
_labels("norm_evidence_reduced", "evidence", L.EVIDENCE_RULES, "link|url", exact=False)


@query(f"SELECT message_id, CASE WHEN {trim_sql('theme')} <> '' THEN {bucket_sql(trim_sql('theme'), L.THEME_RULES_REDUCED)} END AS theme_bucket FROM {MEGA}")
def norm_theme_reduced(spark, sf_dir):
    return table(spark, sf_dir, MEGA).select("message_id", L.norm_theme(F.col("theme"), table=L.THEME_RULES_REDUCED).alias("theme_bucket"))


@query(f"""WITH t AS (SELECT unnest(list_concat(CASE WHEN th IS NULL THEN [] ELSE ['theme=' || th] END, list_transform({ordered('c')}, lambda x: 'claim=' || x), list_transform({ordered('a')}, lambda x: 'cta=' || x), list_transform({ordered('e')}, lambda x: 'evid=' || x))) AS token
    FROM (SELECT {THEME} AS th, {list_sql('claim_types', L.CLAIM_RULES)} AS c, {list_sql('ctas', L.CTA_RULES)} AS a, {list_sql('evidence', L.EVIDENCE_RULES, 'link|url')} AS e FROM {MEGA})) SELECT token, count(*) AS n FROM t GROUP BY token""")
def style_token_counts(spark, sf_dir):
    m = table(spark, sf_dir, MEGA)
    tokens = L.style_tokens(L.norm_theme(F.col("theme")), L.norm_labels(F.col("claim_types"), L.CLAIM_RULES), L.norm_labels(F.col("ctas"), L.CTA_RULES), L.norm_labels(F.col("evidence"), L.EVIDENCE_RULES, "link|url"))
    return m.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def codebook(spark, sf_dir):
    """Core rows with their four fields in codebook labels, constraints applied."""
    core = table(spark, sf_dir, "full_risk_v2_core")
    clean = core.select("row_id", *[L.norm_text(F.col(f)).alias(f) for f in L.CODEBOOK])
    return clean.select("row_id", *[F.array_join(L.enforce(L.codebook_field(F.col(f), f), f), ", ").alias(f"{f}_cb") for f in L.CODEBOOK])


QUERIES["codebook_fields"] = codebook


@query()
def codebook_frequency(spark, sf_dir):
    c = codebook(spark, sf_dir).unpivot(["row_id"], [f"{f}_cb" for f in L.CODEBOOK], "field", "value")
    c = c.select("field", F.explode(F.split("value", ", ")).alias("label")).groupBy("field", "label").agg(F.count("*").alias("n"))
    w = sampling.Window.partitionBy("field").orderBy(F.desc("n"), "label")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 30")


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest({split_sql('ctas')}) AS tag FROM full_risk_v2_core) GROUP BY tag")
def split_multi_counts(spark, sf_dir):
    return table(spark, sf_dir, "full_risk_v2_core").select(F.explode(T.split_multi(F.col("ctas"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


URL = "(https?://[^\\s<>\"]+|www\\.[^\\s<>\"]+)"


@query("SELECT row_id, regexp_replace(regexp_replace(message, 'https?://|http://|www\\.\\S*|t\\.me/\\S*', ' ', 'g'), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS masked FROM full_risk_v2_core WHERE message IS NOT NULL AND regexp_replace(regexp_replace(message, 'https?://|http://|www\\.\\S*|t\\.me/\\S*', ' ', 'g'), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') <> ''")
def url_mask(spark, sf_dir):
    return table(spark, sf_dir, "full_risk_v2_core").where("message is not null").select("row_id", T.url_mask(F.col("message")).alias("masked")).where("masked <> ''")


@query(f"SELECT least(len(regexp_extract_all(text, {q('(?i)' + URL)})), 5) AS n_urls, count(*) AS n FROM raw_corpus WHERE text IS NOT NULL GROUP BY 1")
def url_count_hist(spark, sf_dir):
    return table(spark, sf_dir, "raw_corpus").where("text is not null").groupBy(F.least(F.size(T.urls(F.col("text"))), F.lit(5)).cast("bigint").alias("n_urls")).agg(F.count("*").alias("n"))


@query(f"SELECT bin, n, round(100 * n / sum(n) OVER (), 6) AS percent FROM (SELECT least(length(u) // 10, 10) AS bin, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {q('(?i)' + URL)})) AS u FROM raw_corpus) GROUP BY 1)")
def url_length_hist(spark, sf_dir):
    u = table(spark, sf_dir, "raw_corpus").select(F.explode(T.urls(F.col("text"))).alias("u"))
    h = u.groupBy(F.least(F.floor(F.length("u") / 10), F.lit(10)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(sampling.Window.partitionBy(F.lit(0))), 6))


@query(f"SELECT edge, round(sum(n) OVER (ORDER BY edge DESC) / sum(n) OVER (), 6) AS ccdf FROM (SELECT length(message) // 50 * 50 AS edge, count(*) AS n FROM {MEGA} WHERE message IS NOT NULL GROUP BY 1)")
def message_length_ccdf(spark, sf_dir):
    h = table(spark, sf_dir, MEGA).where("message is not null").groupBy((F.floor(F.length("message") / 50) * 50).cast("bigint").alias("edge")).agg(F.count("*").alias("n"))
    w = sampling.Window.partitionBy(F.lit(0))
    return h.select("edge", F.round(F.sum("n").over(w.orderBy(F.desc("edge")).rowsBetween(sampling.Window.unboundedPreceding, 0)) / F.sum("n").over(w), 6).alias("ccdf"))


@query("SELECT category, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT CASE WHEN trim(coalesce(lang, '')) = '' OR lower(trim(lang)) IN ('nan', 'none') THEN 'Unknown' ELSE upper(substr(trim(lang), 1, 1)) || lower(substr(trim(lang), 2)) END AS category FROM documents) GROUP BY category")
def category_percent(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy(T.category_key(F.col("lang")).alias("category")).agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(sampling.Window.partitionBy(F.lit(0))), 6))


@query("""WITH d AS (SELECT *, try_strptime(msg_date, ['%Y-%m-%d %H:%M:%S+00:00', '%Y-%m-%dT%H:%M:%SZ', '%d.%m.%Y %H:%M', '%Y-%m-%d', '%b %d, %Y %H:%M:%S']) AS ts, regexp_replace(coalesce(text, ''), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS key FROM raw_corpus),
    m AS (SELECT row_id, regexp_replace(coalesce(message, ''), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS key FROM full_risk_v2_core WHERE channel IS NULL AND msg_date IS NULL),
    p AS (SELECT key, count(*) AS match_count, coalesce(string_agg(DISTINCT channel, ';' ORDER BY channel), '') AS match_channels, CASE WHEN count(DISTINCT channel) = 1 THEN min(channel) END AS filled_channel,
          CASE WHEN count(DISTINCT channel) = 1 THEN strftime(min(ts), '%Y-%m-%d %H:%M:%S') END AS filled_date FROM d GROUP BY key)
    SELECT row_id, coalesce(match_count, 0) AS match_count, coalesce(match_channels, '') AS match_channels, filled_channel, filled_date FROM m LEFT JOIN p USING (key)""")
def exact_backfill(spark, sf_dir):
    return backfill.exact_fill(table(spark, sf_dir, "full_risk_v2_core"), table(spark, sf_dir, "raw_corpus"))


@query()
def merged_backfill(spark, sf_dir):
    """Core rows with channel and date filled: exact, fuzzy, then their own."""
    return backfill.merged(table(spark, sf_dir, "full_risk_v2_core"), table(spark, sf_dir, "raw_corpus"))


@query()
def fuzzy_backfill(spark, sf_dir):
    return backfill.fuzzy_fill(table(spark, sf_dir, "full_risk_v2_core"), table(spark, sf_dir, "raw_corpus"))


@query("""WITH d AS (SELECT channel, try_cast(msg_id AS bigint) AS m, min(try_strptime(msg_date, ['%Y-%m-%d %H:%M:%S+00:00', '%Y-%m-%dT%H:%M:%SZ', '%d.%m.%Y %H:%M', '%Y-%m-%d', '%b %d, %Y %H:%M:%S'])) AS ts FROM raw_corpus GROUP BY ALL)
    SELECT row_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS filled_date FROM (SELECT row_id, channel, try_cast(msg_id AS bigint) AS m FROM full_risk_v2_core WHERE channel IS NOT NULL AND msg_date IS NULL) c LEFT JOIN d USING (channel, m) WHERE m IS NOT NULL""")
def date_backfill(spark, sf_dir):
    return backfill.date_fill(table(spark, sf_dir, "full_risk_v2_core"), table(spark, sf_dir, "raw_corpus"))


@query()
def fill_summary(spark, sf_dir):
    return backfill.fill_summary(fuzzy_backfill(spark, sf_dir))


GROUPS = f"""g AS (SELECT seed, normalized_domain, md5(normalized_domain || ':' || seed) AS o FROM (SELECT DISTINCT normalized_domain FROM {MEGA} WHERE normalized_domain IS NOT NULL {{}}) CROSS JOIN (SELECT unnest(range(0, {{}})) AS seed)),
    sp AS (SELECT cast(seed AS int) AS seed, normalized_domain, CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY o, normalized_domain) <= ceil(count(*) OVER (PARTITION BY seed) * 0.2) THEN 'test' ELSE 'train' END AS split FROM g)"""


@query(f"WITH {GROUPS.format('', 10)} SELECT * FROM sp")
def group_split(spark, sf_dir):
    return sampling.group_split(table(spark, sf_dir, MEGA), "normalized_domain", range(10))


@query(f"""WITH {GROUPS.format('AND risk_label IS NOT NULL', 50)}, per AS (SELECT normalized_domain, count(*) AS n, sum(risk_label) AS pos FROM {MEGA} WHERE normalized_domain IS NOT NULL AND risk_label IS NOT NULL GROUP BY 1),
    s AS (SELECT seed, sum(n) FILTER (split = 'test') AS nt, sum(n) AS n, sum(pos) FILTER (split = 'test') AS pt, sum(pos) AS p FROM per JOIN sp USING (normalized_domain) GROUP BY seed),
    r AS (SELECT seed, round(nt / n, 6) AS test_share, round(pt / nt, 6) AS test_rate, round((p - pt) / (n - nt), 6) AS train_rate FROM s), t AS (SELECT *, round(abs(test_rate - train_rate), 6) AS gap FROM r)
    SELECT *, cast(row_number() OVER (ORDER BY gap, seed) = 1 AS int) AS is_best FROM t""")
def best_group_split(spark, sf_dir):
    return sampling.best_group_split(table(spark, sf_dir, MEGA), "normalized_domain", "risk_label", range(50))


@query(f"SELECT message_id, risk_label, CASE WHEN row_number() OVER (PARTITION BY risk_label ORDER BY md5(message_id::varchar || ':43'), message_id) <= round(count(*) OVER (PARTITION BY risk_label) * 0.125) THEN 'val' ELSE 'train' END AS split FROM {MEGA} WHERE risk_label IS NOT NULL")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(table(spark, sf_dir, MEGA), "message_id", "risk_label", 43)


@query(f"""WITH r AS (SELECT theme, normalized_domain AS g FROM {MEGA} WHERE theme IS NOT NULL), f AS (SELECT DISTINCT theme AS fold FROM r), t AS (SELECT DISTINCT theme AS fold, g FROM r)
    SELECT *, cast(n_train >= 1000 AS int) AS usable FROM (SELECT fold, (SELECT count(*) FROM r WHERE theme = fold) AS n_test, (SELECT count(*) FROM r WHERE theme <> fold AND NOT EXISTS (SELECT 1 FROM t WHERE t.fold = f.fold AND t.g = r.g)) AS n_train FROM f)""")
def leave_one_theme_out(spark, sf_dir):
    return sampling.leave_one_out(table(spark, sf_dir, MEGA), "message_id", "theme", "normalized_domain")


@query(f"SELECT message_id FROM {MEGA} ORDER BY md5(message_id::varchar || ':123'), message_id LIMIT 200")
def seeded_sample(spark, sf_dir):
    return sampling.seeded_sample(table(spark, sf_dir, MEGA).select("message_id"), "message_id", 200, 123)


LOG = """log AS (SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY split) AS pos, y_pred, p_hat_raw AS p, CASE WHEN message_id % 7 = 0 THEN 'timeout' END AS error,
    message_id % 11 * 10 AS prompt_tokens, message_id % 5 AS completion_tokens FROM baseline_scores)"""


def log(spark, sf_dir):
    """Answer log made from the scores: every seventh message failed."""
    s = table(spark, sf_dir, "baseline_scores")
    m = F.col("message_id")
    w = sampling.Window.partitionBy("message_id").orderBy("split")
    return s.select(
        "message_id", F.row_number().over(w).alias("pos"), "y_pred", F.col("p_hat_raw").alias("p"), F.when(m % 7 == 0, "timeout").alias("error"), "split",
        F.struct((m % 11 * 10).cast("int").alias("prompt_tokens"), (m % 5).cast("int").alias("completion_tokens")).alias("usage"), (m % 3).cast("double").alias("elapsed_s"),
    )


@query(f"SELECT message_id FROM {MEGA} ANTI JOIN (SELECT message_id FROM baseline_scores WHERE message_id % 7 <> 0) USING (message_id)")
def resume_remaining(spark, sf_dir):
    return A.remaining(table(spark, sf_dir, MEGA).select("message_id"), log(spark, sf_dir))


@query(f"SELECT signal_key, count(*) AS n FROM {MEGA} CROSS JOIN (SELECT 'signal_' || lpad(i::varchar, 2, '0') AS signal_key, i FROM range(1, 20) r(i)) WHERE NOT (message_id % 7 <> 0 AND message_id % 19 + 1 = i AND message_id IN (SELECT message_id FROM baseline_scores)) GROUP BY signal_key")
def resume_pairs(spark, sf_dir):
    done = log(spark, sf_dir).select("message_id", F.format_string("signal_%02d", F.col("message_id") % 19 + 1).alias("signal_key"), "error")
    return A.remaining_pairs(table(spark, sf_dir, MEGA), done, A.SIGNALS).groupBy("signal_key").agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT message_id, y_pred, round(p, 6) AS p FROM log WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY pos DESC) = 1")
def latest_answers(spark, sf_dir):
    return A.latest(log(spark, sf_dir), ["message_id"], ["pos"]).select("message_id", "y_pred", F.round("p", 6).alias("p"))


@query("SELECT split, count(*) FILTER (message_id % 7 <> 0) AS ok, count(*) FILTER (message_id % 7 = 0) AS err, cast(sum(message_id % 11 * 10) AS bigint) AS prompt_tokens, cast(sum(message_id % 5) AS bigint) AS completion_tokens, cast(sum(message_id % 3) AS double) AS elapsed_s, round(sum(message_id % 11 * 10) * 0.15e-6 + sum(message_id % 5) * 0.6e-6, 6) AS cost FROM baseline_scores GROUP BY split")
def usage_rollup(spark, sf_dir):
    return A.usage(log(spark, sf_dir), "split")


def answers(spark, sf_dir):
    """Nineteen answers per message, one of them missing for every tenth message."""
    m = table(spark, sf_dir, MEGA).select("message_id")
    i = F.posexplode(F.array(*map(F.lit, A.SIGNALS))).alias("i", "signal_key")
    a = F.element_at(F.array(F.lit("Yes"), F.lit("No"), F.lit("Unsure")), ((F.col("message_id") + F.col("i") * F.col("i")) % 3 + 1).cast("int"))
    return m.select("message_id", i).where("not (message_id % 10 = 0 and i = 4)").select("message_id", "signal_key", "i", a.alias("answer"))


CODE = "CASE (message_id + i * i) % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END"


@query(f"SELECT message_id, {', '.join(CODE.replace('i * i', str(i * i)) + f' AS signal_{i + 1:02d}' for i in range(19))} FROM {MEGA} WHERE message_id % 10 <> 0")
def signal_table(spark, sf_dir):
    return A.signal_table(answers(spark, sf_dir), A.SIGNALS)


@query(f"SELECT 'signal_' || lpad((i + 1)::varchar, 2, '0') AS signal_key, {CODE} AS code, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY i), 6) AS share FROM {MEGA} CROSS JOIN range(0, 19) r(i) WHERE NOT (message_id % 10 = 0 AND i = 4) GROUP BY i, code")
def signal_distribution(spark, sf_dir):
    c = answers(spark, sf_dir).groupBy("signal_key", A.signal_code(F.col("answer")).alias("code")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(sampling.Window.partitionBy("signal_key")), 6))


@query("SELECT round(avg(cast(a IS NOT DISTINCT FROM b AS int)), 6) AS agreement, count(*) AS n FROM (SELECT DISTINCT message_id, y_pred AS a, cast(p_hat_calibrated >= 0.5 AS int) AS b FROM baseline_scores)")
def agreement(spark, sf_dir):
    s = table(spark, sf_dir, "baseline_scores").select("message_id", F.col("y_pred").alias("a"), (F.col("p_hat_calibrated") >= 0.5).cast("int").alias("b")).distinct()
    return s.agg(F.round(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("int")), 6).alias("agreement"), F.count("*").alias("n"))


@query(f"SELECT row_id, theme, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(claim_types, '[,;]'), lambda x: {trim_sql('x')}), lambda x: x <> ''))), '|') AS claims FROM (SELECT row_id, trim(theme) AS theme, regexp_replace(replace(replace(replace(claim_types, '‑', '-'), '–', '-'), '—', '-'), '\\n', ' ', 'g') AS claim_types FROM full_risk_v2_core WHERE theme IS NOT NULL AND claim_types IS NOT NULL)")
def parsed_labels(spark, sf_dir):
    c = table(spark, sf_dir, "full_risk_v2_core").where("theme is not null and claim_types is not null")
    text = F.concat(F.lit("M61\ntheme: x\nTheme : "), F.col("theme"), F.lit("\nclaim_types: "), F.translate("claim_types", "\n", " "), F.lit("\nfoo: y"))
    m = A.parsed_labels(text)
    return c.select("row_id", m["theme"].alias("theme"), F.array_join(A.value_list(m["claim_types"]), "|").alias("claims"))


@query("SELECT round(100 * avg(cast(a.theme IS NOT DISTINCT FROM b.theme AS int)), 6) AS theme_match, round(100 * avg(cast(a.theme IS NOT DISTINCT FROM b.theme AND a.claim_types IS NOT DISTINCT FROM b.claim_types AND a.ctas IS NOT DISTINCT FROM b.ctas AND a.evidence IS NOT DISTINCT FROM b.evidence AS int)), 6) AS all_match, count(*) AS n FROM full_risk_v2_core a JOIN full_risk_v2_core b ON b.row_id = a.row_id + 1")
def exact_match(spark, sf_dir):
    c = table(spark, sf_dir, "full_risk_v2_core").select("row_id", "theme", "claim_types", "ctas", "evidence")
    b = c.select((F.col("row_id") - 1).alias("row_id"), *[F.col(x).alias(f"b_{x}") for x in c.columns[1:]])
    same = [F.col(x).eqNullSafe(F.col(f"b_{x}")) for x in c.columns[1:]]
    return c.join(b, "row_id").agg(F.round(100 * F.avg(same[0].cast("int")), 6).alias("theme_match"), F.round(100 * F.avg((same[0] & same[1] & same[2] & same[3]).cast("int")), 6).alias("all_match"), F.count("*").alias("n"))


@query()
def fuzzy_agreement(spark, sf_dir):
    """Agreement of the claim labels of consecutive core rows by greedy fuzzy matching."""
    c = table(spark, sf_dir, "full_risk_v2_core").select("row_id", A.value_list(F.coalesce("claim_types", F.lit(""))).alias("a"))
    return agreement_ops.greedy_agreement(c.join(c.select((F.col("row_id") - 1).alias("row_id"), F.col("a").alias("b")), "row_id"), "row_id", "a", "b")


@query("""SELECT row_id, regexp_extract(regexp_extract(message, 'https?://[^\\s<>"]+|www\\.[^\\s<>"]+'), '^https?://[a-zA-Z0-9/:._?=&%#~+,@-]+') AS url FROM full_risk_v2_core WHERE message IS NOT NULL AND regexp_extract(regexp_extract(message, 'https?://[^\\s<>"]+|www\\.[^\\s<>"]+'), '^https?://[a-zA-Z0-9/:._?=&%#~+,@-]+') <> ''""")
def first_urls(spark, sf_dir):
    return table(spark, sf_dir, "full_risk_v2_core").where("message is not null").select("row_id", prompting.first_url(F.col("message")).alias("url")).where("url is not null")


@query("SELECT row_id, CASE WHEN NOT contains(message, 'http') THEN 0 WHEN length(message) < 50 THEN 3 WHEN length(message) < 100 THEN 2 ELSE 0 END AS max_results, 'message text:' || message AS prompt FROM full_risk_v2_core WHERE message IS NOT NULL")
def chat_samples(spark, sf_dir):
    c = table(spark, sf_dir, "full_risk_v2_core").where("message is not null")
    chat = prompting.chat(F.lit("Tag the message."), F.col("message"))
    return c.select("row_id", prompting.search_results_wanted(F.col("message")).alias("max_results"), F.element_at(chat, -1)["content"].alias("prompt"))


@query(f"SELECT split, printf('%.3f ± %.3f', avg(p_hat_raw), stddev_samp(p_hat_raw)) AS cell FROM baseline_scores WHERE split IS NOT NULL GROUP BY split")
def mean_std_cells(spark, sf_dir):
    return table(spark, sf_dir, "baseline_scores").where("split is not null").groupBy("split").agg(F.format_string("%.3f ± %.3f", F.avg("p_hat_raw"), F.stddev_samp("p_hat_raw")).alias("cell"))


@query(f"SELECT message_id, CASE WHEN length(t) > 220 THEN substr(t, 1, 220) || '…' ELSE t END AS excerpt FROM (SELECT message_id, {trim_sql("replace(message, chr(10), ' ')")} AS t FROM {MEGA} WHERE message IS NOT NULL)")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, MEGA).where("message is not null").select("message_id", T.excerpt(F.col("message")).alias("excerpt"))
