"""Queries of curation, ingestion audits, statistics of runs and chats, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.decode import decoded
from tessera.functions.text import folding_table, normal, ordering, prompt_group, squeeze
from tessera.operators import audit, curate, evaluate
from tessera.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query with its SQL."""

    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return keep


def folded_sql(texts: str) -> str:
    """CTEs that end in normed(t, norm): the normalised form of the distinct texts that the query `texts` gives as t. The
    characters that plain lower case doesn't settle are looked up in a table made by the Unicode rules."""
    quoted = lambda c: c.replace("'", "''")
    table_ = ", ".join(f"('{quoted(c)}', '{quoted(f)}')" for c, f in folding_table())
    return f"""fold(c, f) AS (VALUES {table_}),
texts AS (SELECT DISTINCT t FROM ({texts}) WHERE t IS NOT NULL),
parted AS (SELECT t, unnest(l) AS c, unnest(range(len(l))) AS i FROM (SELECT t, regexp_extract_all(t, '(?s).') AS l FROM texts)),
joined AS (SELECT t, string_agg(coalesce(f, lower(c)), '' ORDER BY i) AS x FROM parted LEFT JOIN fold USING (c) GROUP BY 1),
normed AS (SELECT t, trim(regexp_replace(nfc_normalize(coalesce(x, '')), '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g')) AS norm FROM texts LEFT JOIN joined USING (t))"""


DOCS_SQL = "WITH " + folded_sql("SELECT text AS t FROM documents") + ", docs AS (SELECT doc_id, source, lang, norm, sha256(norm) AS grp FROM documents JOIN normed ON text = t)"
GROUPS_SQL = DOCS_SQL + ", groups AS (SELECT DISTINCT grp FROM docs), ranked AS (SELECT grp, row_number() OVER (ORDER BY sha256('42:' || grp)) AS rank FROM groups), total AS (SELECT count(*) AS n FROM groups)"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "source", "lang", normal(F.col("text")).alias("norm"), prompt_group(F.col("text")).alias("grp"))


@query("text_normal", DOCS_SQL + " SELECT doc_id, norm, grp FROM docs")
def text_normal(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised texts and their digests."""
    return _docs(spark, folder).select("doc_id", "norm", "grp")


@query("dedup_first_wins", DOCS_SQL + " SELECT grp, min(doc_id) AS doc_id FROM docs GROUP BY 1")
def dedup_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The first document of each normalised text."""
    return curate.first_wins(_docs(spark, folder), "grp", ["doc_id"]).select("grp", "doc_id")


@query("dedup_two_keys", DOCS_SQL + ", keyed AS (SELECT doc_id, sha256(grp || '|' || coalesce(source, '')) AS k FROM docs) SELECT k, min(doc_id) AS doc_id, count(*) AS copies FROM keyed GROUP BY 1")
def dedup_two_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The first document of each text and source, with the number of copies."""
    keyed = _docs(spark, folder).select("doc_id", F.sha2(F.concat_ws("|", "grp", F.coalesce("source", F.lit(""))), 256).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("dedup_count", DOCS_SQL + " SELECT count(*) AS texts, count(DISTINCT grp) AS distinct_texts, count(*) - count(DISTINCT grp) AS duplicates FROM docs")
def dedup_count(spark: SparkSession, folder: str) -> DataFrame:
    """Texts, different ones, duplicates."""
    each = _docs(spark, folder).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.count(F.lit(1)).alias("distinct_texts")).withColumn("duplicates", F.col("texts") - F.col("distinct_texts"))


def _groups(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    groups = _docs(spark, folder).select("grp").distinct().withColumn("digest", ordering(42, F.col("grp")))
    return groups, groups.count()


@query("split_integer", GROUPS_SQL + """, parts AS (SELECT n, n * 80 // 100 AS a, n * 10 // 100 AS b, n - n * 80 // 100 - 2 * (n * 10 // 100) AS spare, n * 80 % 100 AS ra, n * 10 % 100 AS rb FROM total),
sizes AS (SELECT a + CASE WHEN spare > 0 AND (ra >= rb OR spare > 2) THEN 1 ELSE 0 END AS train, b + CASE WHEN spare > CASE WHEN ra >= rb THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS val FROM parts)
SELECT grp, CASE WHEN rank <= train THEN 'train' WHEN rank <= train + val THEN 'val' ELSE 'test' END AS split FROM ranked, sizes""")
def split_integer(spark: SparkSession, folder: str) -> DataFrame:
    """80/10/10 by largest remainder in whole numbers, in seeded order."""
    groups, n = _groups(spark, folder)
    return curate.seeded_split(groups, "digest", tuple(curate.split_sizes(n).items())).select("grp", "split")


@query("split_ratio", GROUPS_SQL + """, exact AS (SELECT n, n * 0.7::DOUBLE AS a, n * 0.2::DOUBLE AS b, n * 0.1::DOUBLE AS c FROM total),
parts AS (SELECT n, unnest([a, b, c]) AS x, unnest([1, 2, 3]) AS i FROM exact),
given AS (SELECT i, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, i) <= n - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS size FROM parts),
sizes AS (SELECT sum(size) FILTER (i = 1) AS train, sum(size) FILTER (i = 2) AS val FROM given)
SELECT grp, CASE WHEN rank <= train THEN 'train' WHEN rank <= train + val THEN 'val' ELSE 'test' END AS split FROM ranked, sizes""")
def split_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """70/20/10 by largest remainder in floating point, in seeded order."""
    groups, n = _groups(spark, folder)
    return curate.seeded_split(groups, "digest", tuple(zip(("train", "val", "test"), curate.ratio_sizes(n, (0.7, 0.2, 0.1))))).select("grp", "split")


@query("split_group_fraction", GROUPS_SQL + ", size AS (SELECT least(n - 1, greatest(1, round_even(n * 0.2::DOUBLE, 0))) AS val FROM total) SELECT d.doc_id, CASE WHEN rank <= val THEN 'validation' ELSE 'train' END AS split FROM docs d JOIN ranked r ON d.grp = r.grp, size")
def split_group_fraction(spark: SparkSession, folder: str) -> DataFrame:
    """A fifth of the groups, with all their documents, for validation."""
    docs = _docs(spark, folder)
    groups, n = _groups(spark, folder)
    size = curate.validation_size(n, 0.2)
    split = curate.seeded_split(groups, "digest", (("validation", size), ("train", n - size)))
    return docs.join(split, "grp").select("doc_id", "split")


@query("split_stats", SQL["split_group_fraction"].replace("SELECT d.doc_id,", "SELECT d.doc_id, d.source,", 1).replace("WITH fold", "WITH split AS (WITH fold", 1) + ") SELECT split, count(*) AS documents, count(DISTINCT source) AS sources FROM split GROUP BY 1")
def split_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and sources by split."""
    sources = table(spark, folder, "documents").select("doc_id", "source")
    joined = split_group_fraction(spark, folder).join(sources, "doc_id")
    return joined.groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"))


# Prompts by their group, and the groups that evaluation holds: those of ids in val or test.
_SPLIT = "CASE lower(regexp_replace(split, '[^\\p{L}]', '', 'g')) WHEN 'validation' THEN 'val' ELSE lower(regexp_replace(split, '[^\\p{L}]', '', 'g')) END"
HOLDOUT_SQL = "WITH " + folded_sql("SELECT prompt AS t FROM prompt_specs") + f""", prompts AS (SELECT DISTINCT id, sha256(norm) AS grp FROM prompt_specs JOIN normed ON prompt = t WHERE id IS NOT NULL),
listed AS (SELECT id, bool_or({_SPLIT} IN ('val', 'test')) AS held, bool_or({_SPLIT} = 'train') AS train FROM split_membership WHERE id IS NOT NULL GROUP BY 1),
held AS (SELECT DISTINCT grp FROM prompts JOIN listed USING (id) WHERE held)"""


def _prompts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(id, grp, evaluation_only, train) of all prompts, and the groups that evaluation holds."""
    split = F.lower(F.regexp_replace("split", r"[^\p{L}]", ""))
    split = F.when(split == "validation", "val").otherwise(split)
    listed = table(spark, folder, "split_membership").where("id IS NOT NULL").groupBy("id").agg(F.max(split.isin("val", "test")).alias("held"), F.max(split == "train").alias("train"))
    prompts = table(spark, folder, "prompt_specs").where("id IS NOT NULL AND prompt IS NOT NULL").select("id", prompt_group(F.col("prompt")).alias("grp")).distinct()
    rows = prompts.join(listed, "id", "left").select("id", "grp", F.coalesce("held", F.lit(False)).alias("evaluation_only"), F.coalesce("train", F.lit(False)).alias("train"))
    return rows, rows.where("evaluation_only").select("grp").distinct()


@query("holdout_overlap", HOLDOUT_SQL + " SELECT grp, count(*) AS prompts FROM prompts JOIN listed USING (id) WHERE train AND grp IN (SELECT grp FROM held) GROUP BY 1")
def holdout_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt groups of evaluation that training holds too, with the training prompts of each."""
    rows, held = _prompts(spark, folder)
    return curate.overlap(rows.where("train"), held, "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("prompts"))


@query("holdout_admitted", HOLDOUT_SQL + " SELECT p.id, p.grp FROM prompts p LEFT JOIN listed l USING (id) WHERE NOT coalesce(held, false) AND grp NOT IN (SELECT grp FROM held)")
def holdout_admitted(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts that may be trained on: not for evaluation only, and of no group that evaluation holds."""
    rows, held = _prompts(spark, folder)
    return curate.admitted(rows, held, "grp", "evaluation_only").select("id", "grp")


# Lines on both sides: the sentences of the held-out items and of the documents.
LINES_SQL = "held AS (SELECT DISTINCT lower(trim(s)) AS line FROM (SELECT unnest(string_split(text, '. ')) AS s FROM eval_items) WHERE trim(s) <> ''), lines AS (SELECT DISTINCT lower(trim(s)) AS line FROM (SELECT unnest(string_split(text, '. ')) AS s FROM documents) WHERE trim(s) <> '')"


def _lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    each = lambda name: table(spark, folder, name).select(F.explode(F.split("text", r"\. ")).alias("s")).where("trim(s) <> ''").select(F.lower(F.trim("s")).alias("line")).distinct()
    return each("eval_items"), each("documents")


@query("set_intersect", f"WITH {LINES_SQL} SELECT line FROM held INTERSECT SELECT line FROM lines")
def set_intersect(spark: SparkSession, folder: str) -> DataFrame:
    """Lines on both sides."""
    held, lines = _lines(spark, folder)
    return held.intersect(lines)


@query("set_except", f"WITH {LINES_SQL} SELECT line FROM held EXCEPT SELECT line FROM lines")
def set_except(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the items that no document has."""
    held, lines = _lines(spark, folder)
    return held.subtract(lines)


@query("set_union", f"WITH {LINES_SQL} SELECT line, 'held' AS lineage FROM held UNION ALL SELECT line, 'corpus' FROM lines")
def set_union(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides with their lineage."""
    held, lines = _lines(spark, folder)
    return held.withColumn("lineage", F.lit("held")).unionByName(lines.withColumn("lineage", F.lit("corpus")))


@query("set_unique", "SELECT message_key, count(*) AS rows FROM messages GROUP BY 1 HAVING count(*) > 1")
def set_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that were delivered more than once."""
    return table(spark, folder, "messages").groupBy("message_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


CHATS_SQL = "WITH turns AS (SELECT id, turn, arg_min(role, message_key) AS role, arg_min(struct_pack(c := content), message_key).c AS content FROM messages WHERE id IS NOT NULL GROUP BY 1, 2), chats AS (SELECT id, string_agg(coalesce(role, '?'), ',' ORDER BY turn) AS roles FROM turns GROUP BY 1)"


@query("chat_role_gate", CHATS_SQL + " SELECT id, roles, roles = 'system,user,assistant' AS training FROM chats")
def chat_role_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The roles of each chat, and whether they are those of a training sample."""
    made = curate.chats(table(spark, folder, "messages"))
    return made.select("id", F.array_join(curate.roles(), ",", "?").alias("roles"), F.coalesce(curate.is_training_chat(), F.lit(False)).alias("training"))


@query("chat_first_prompt", CHATS_SQL + " SELECT id, arg_min(content, turn) AS prompt FROM turns WHERE role = 'user' AND content IS NOT NULL GROUP BY 1")
def chat_first_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """The first user turn with content of each chat."""
    made = curate.chats(table(spark, folder, "messages"))
    asked = F.filter("messages", lambda m: (m["role"] == "user") & m["content"].isNotNull())
    return made.select("id", F.get(asked, F.lit(0))["content"].alias("prompt")).where("prompt IS NOT NULL")


@query("chat_alpaca", CHATS_SQL + " SELECT t.id, max(content) FILTER (role = 'user') AS instruction, '' AS input, max(content) FILTER (role = 'assistant') AS output, max(content) FILTER (role = 'system') AS system FROM turns t JOIN chats c ON t.id = c.id WHERE c.roles = 'system,user,assistant' GROUP BY 1")
def chat_alpaca(spark: SparkSession, folder: str) -> DataFrame:
    """Training chats as instruction, input, output and system text."""
    made = curate.chats(table(spark, folder, "messages")).where(curate.is_training_chat())
    at = lambda i: F.get("messages", F.lit(i))["content"]
    return made.select("id", at(1).alias("instruction"), F.lit("").alias("input"), at(2).alias("output"), at(0).alias("system"))


@query("chat_admission", CHATS_SQL + ", flat AS (SELECT t.id, any_value(c.roles) AS roles, max(content) FILTER (role = 'user') AS prompt, max(content) FILTER (role = 'assistant') AS answer FROM turns t JOIN chats c ON t.id = c.id GROUP BY 1), judged AS (SELECT CASE WHEN roles <> 'system,user,assistant' THEN 'roles' WHEN prompt IS NULL OR NOT regexp_matches(prompt, '\\S') THEN 'blank_prompt' WHEN length(prompt) > 8000 THEN 'long_prompt' WHEN answer IS NULL OR answer = '' THEN 'no_answer' ELSE 'admitted' END AS reason FROM flat) SELECT reason, count(*) AS chats FROM judged GROUP BY 1")
def chat_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Chats by the first rule they break."""
    made = curate.chats(table(spark, folder, "messages"))
    says = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    rules = [("roles", curate.is_training_chat()), ("blank_prompt", says("user").rlike(r"\S")), ("long_prompt", F.char_length(says("user")) <= 8000), ("no_answer", F.char_length(says("assistant")) > 0)]
    return made.select(F.coalesce(curate.reject_reason(rules), F.lit("admitted")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("chats"))


LOG_SQL = "WITH log AS (SELECT *, event_type = 'error' AS bad FROM events)"
ORDER = ["ts", "event_id"]


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("audit_breaker", LOG_SQL + ", runs AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM log), streaks AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS streak FROM runs) SELECT user_id, min(ts) AS first FROM streaks WHERE streak = 3 GROUP BY 1")
def audit_breaker(spark: SparkSession, folder: str) -> DataFrame:
    """When three errors in a row first stop each actor."""
    return audit.breakers(_log(spark, folder), "user_id", ORDER, F.col("event_type") == "error")


@query("audit_budget", LOG_SQL + ", spent AS (SELECT *, coalesce(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM log) SELECT user_id, count(*) AS events FROM spent WHERE s < 300 GROUP BY 1")
def audit_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each actor before the budget is used up."""
    kept = audit.within_budget(_log(spark, folder), "user_id", ORDER, F.floor("value").cast("long"), 300)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))


@query("audit_stop", LOG_SQL + ", stops AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM log) SELECT user_id, count(*) AS events, max(ts) AS last FROM stops WHERE s = 0 GROUP BY 1")
def audit_stop(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each actor up to the one that stops it at once."""
    kept = audit.until_stop(_log(spark, folder), "user_id", ORDER, F.col("event_type") == "signup")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last"))


@query("audit_latest", LOG_SQL + ", n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM log) SELECT user_id, event_type FROM n WHERE k = 1")
def audit_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest state of each actor."""
    return audit.latest(_log(spark, folder), "user_id", ORDER, "event_type")


@query("audit_resume", "WITH done AS (SELECT DISTINCT case_id FROM run_records WHERE status = 'success') SELECT DISTINCT id FROM prompt_specs WHERE id NOT IN (SELECT case_id FROM done WHERE case_id IS NOT NULL)")
def audit_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Cases that have no finished run yet."""
    done = table(spark, folder, "run_records").where("status = 'success'").select(F.col("case_id").alias("id"))
    return table(spark, folder, "prompt_specs").select("id").distinct().join(done, "id", "left_anti")


@query("audit_round_robin", "SELECT event_id, ['near','inside','connected_to'][CAST(event_id % 3 AS INTEGER) + 1] AS assigned FROM events")
def audit_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """Items dealt in turn."""
    return table(spark, folder, "events").select("event_id", F.element_at(F.array(F.lit("near"), F.lit("inside"), F.lit("connected_to")), (F.col("event_id") % 3 + 1).cast("int")).alias("assigned"))


RUNS_SQL = "WITH runs AS (SELECT DISTINCT run_id, case_id, provider, model, source, status, started_at, finished_at, epoch_us(finished_at) - epoch_us(started_at) AS us FROM run_records)"


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    made = table(spark, folder, "run_records").select("run_id", "case_id", "provider", "model", "source", "status", "started_at", "finished_at").distinct()
    # Timestamps without zone are counted as if in UTC.
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return made.withColumn("us", micros("finished_at") - micros("started_at"))


@query("run_durations", RUNS_SQL + " SELECT model, count(*) AS runs, count(*) FILTER (us > 0) AS timed, CAST(coalesce(sum(us) FILTER (us > 0), 0) AS BIGINT) AS micros FROM runs GROUP BY 1")
def run_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Runs, those with a usable duration, and its sum, by model."""
    good = F.col("us") > 0
    return _runs(spark, folder).groupBy("model").agg(F.count(F.lit(1)).alias("runs"), F.count_if(good).alias("timed"), F.coalesce(F.sum(F.when(good, F.col("us"))), F.lit(0)).alias("micros"))


@query("run_progress", RUNS_SQL + ", planned AS (SELECT count(DISTINCT id) AS n FROM prompt_specs), s AS (SELECT count(*) FILTER (status = 'success') AS succeeded, count(*) AS processed, sum(us) FILTER (us > 0) AS us, count(*) FILTER (us > 0) AS timed FROM runs) SELECT n AS planned, processed, n - processed AS pending, succeeded, processed - succeeded AS failed, round(succeeded / nullif(processed, 0), 6) AS success_rate, CAST(us // nullif(timed, 0) * (n - processed) AS BIGINT) AS remaining_micros FROM planned, s")
def run_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress of the inventory: rates are null where nothing was processed."""
    planned = table(spark, folder, "prompt_specs").agg(F.count_distinct("id")).first()[0]
    good = F.col("us") > 0
    done = _runs(spark, folder).agg(F.count_if(F.col("status") == "success").alias("succeeded"), F.count(F.lit(1)).alias("processed"), F.sum(F.when(good, F.col("us"))).alias("us"), F.count_if(good).alias("timed"))
    pending = F.col("planned") - F.col("processed")
    return done.withColumn("planned", F.lit(planned)).select("planned", "processed", pending.alias("pending"), "succeeded", (F.col("processed") - F.col("succeeded")).alias("failed"), F.round(F.try_divide("succeeded", "processed"), 6).alias("success_rate"), (F.expr("try_divide(us - us % timed, timed)").cast("long") * pending).alias("remaining_micros"))


@query("run_status_distribution", RUNS_SQL + " SELECT coalesce(status, 'interrupted') AS status, count(*) AS runs FROM runs GROUP BY 1")
def run_status_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Runs by status; a missing one means interrupted."""
    return _runs(spark, folder).groupBy(F.coalesce("status", F.lit("interrupted")).alias("status")).agg(F.count(F.lit(1)).alias("runs"))


@query("run_theme_outcomes", "WITH runs AS (SELECT DISTINCT run_id, case_id, status FROM run_records), specs AS (SELECT id, min(theme) AS theme FROM prompt_specs GROUP BY 1), themes AS (SELECT unnest(['forest','city','desert','ice','dungeon','fantasy','cyberpunk']) AS theme) SELECT t.theme, count(r.run_id) FILTER (r.status = 'success') AS succeeded, count(r.run_id) FILTER (r.status IS DISTINCT FROM 'success') AS failed FROM themes t LEFT JOIN specs s ON t.theme = s.theme LEFT JOIN runs r ON r.case_id = s.id GROUP BY 1")
def run_theme_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes by theme, all themes, zero-filled."""
    from tessera.domain import THEME_BIOMES

    specs = table(spark, folder, "prompt_specs").groupBy("id").agg(F.min("theme").alias("theme"))
    joined = _runs(spark, folder).select("case_id", F.col("status").eqNullSafe("success").alias("ok")).join(specs, F.col("case_id") == F.col("id"))
    counted = joined.groupBy("theme").agg(F.count_if("ok").alias("s"), F.count_if(~F.col("ok")).alias("f"))
    themes = spark.createDataFrame([(t,) for t in THEME_BIOMES], "theme string")
    return F.broadcast(themes).join(counted, "theme", "left").select("theme", F.coalesce("s", F.lit(0)).alias("succeeded"), F.coalesce("f", F.lit(0)).alias("failed"))


@query("run_models", RUNS_SQL + " SELECT provider, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM runs WHERE provider IS NOT NULL GROUP BY 1")
def run_models(spark: SparkSession, folder: str) -> DataFrame:
    """The models seen of each provider, sorted."""
    return _runs(spark, folder).where("provider IS NOT NULL").groupBy("provider").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


@query("prompt_summary", "WITH specs AS (SELECT id, min(theme) AS theme, min(prompt) AS prompt FROM prompt_specs GROUP BY 1) SELECT coalesce(theme, 'legacy') AS theme, count(*) AS prompts, count(DISTINCT prompt) AS distinct_prompts, count(*) FILTER (prompt IS NULL OR length(prompt) > 8000) AS refused FROM specs GROUP BY 1")
def prompt_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The inventory by theme."""
    specs = table(spark, folder, "prompt_specs").groupBy("id").agg(F.min("theme").alias("theme"), F.min("prompt").alias("prompt"))
    refused = F.coalesce(F.char_length("prompt") > 8000, F.lit(True))
    return specs.groupBy(F.coalesce("theme", F.lit("legacy")).alias("theme")).agg(F.count(F.lit(1)).alias("prompts"), F.count_distinct("prompt").alias("distinct_prompts"), F.count_if(refused).alias("refused"))


@query("prompt_expectations", "WITH specs AS (SELECT id, any_value(expectations) AS e FROM prompt_specs GROUP BY 1), entries AS (SELECT unnest(map_entries(e.object_counts)) AS x FROM specs) SELECT x.key AS kind, count(*) AS prompts, sum(x.value)::BIGINT AS objects FROM entries GROUP BY 1")
def prompt_expectations(spark: SparkSession, folder: str) -> DataFrame:
    """Expected objects over the inventory, by type."""
    specs = table(spark, folder, "prompt_specs").dropDuplicates(["id"])
    return specs.select(F.explode("expectations.object_counts").alias("kind", "n")).groupBy("kind").agg(F.count(F.lit(1)).alias("prompts"), F.sum("n").alias("objects"))


@query("prediction_match", "WITH asked AS (SELECT DISTINCT id FROM messages WHERE id IS NOT NULL UNION SELECT id FROM suite_cases), answered AS (SELECT id, count(DISTINCT prediction_key) AS n FROM predictions WHERE id IS NOT NULL GROUP BY 1) SELECT CASE WHEN q.id IS NULL THEN 'unknown' WHEN a.id IS NULL THEN 'missing' WHEN a.n > 1 THEN 'several' ELSE 'one' END AS match, count(*) AS ids FROM asked q FULL JOIN answered a ON q.id = a.id GROUP BY 1")
def prediction_match(spark: SparkSession, folder: str) -> DataFrame:
    """How samples and predictions match: one to one, several, missing, unknown."""
    asked = table(spark, folder, "messages").where("id IS NOT NULL").select("id").union(table(spark, folder, "suite_cases").select("id")).distinct().withColumn("q", F.lit(True))
    keys = table(spark, folder, "predictions").where("id IS NOT NULL").select("id", "prediction_key").distinct()
    joined = asked.join(keys.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "full")
    match = F.when(F.col("q").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "several").otherwise("one")
    return joined.groupBy(match.alias("match")).agg(F.count(F.lit(1)).alias("ids"))


@query("json_props", "SELECT event_type, count(*) AS events, count(*) FILTER (json_valid(props)) AS valid, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """Well-formed properties and the sum of a member, by type of event."""
    rows = table(spark, folder, "events").select("event_type", F.try_parse_json("props").isNotNull().alias("ok"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if("ok").alias("valid"), F.sum("k").alias("k"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "predictions").where("prediction_key IS NOT NULL").select("prediction_key", "variant", "raw_response")
    return decoded(rows.dropDuplicates(["prediction_key"]), "raw_response")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on all predictions against the expectations of their prompt or suite case."""
    rows = table(spark, folder, "predictions").where("prediction_key IS NOT NULL").select("prediction_key", "id", "variant", "raw_response").dropDuplicates(["prediction_key"])
    wanted = table(spark, folder, "prompt_specs").select("id", "expectations").dropDuplicates(["id"]).unionByName(table(spark, folder, "suite_cases").select("id", "expectations"))
    return evaluate.verdicts(rows.join(wanted, "id", "left"), "raw_response", "expectations")


@query("strict_rates")
def strict_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of predictions, by variant, that are JSON, meet the schema, the geometry, the counts and all expectations."""
    return evaluate.rates(_judged(spark, folder), "variant")


@query("strict_statuses")
def strict_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions by variant and the first layer they fail."""
    return _judged(spark, folder).groupBy("variant", "status").agg(F.count(F.lit(1)).alias("predictions"))


@query("strict_issue_codes")
def strict_issue_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Schema issues of the predictions, by code, and the samples that have them."""
    issues = _answers(spark, folder).select("prediction_key", F.explode("schema_issues.code").alias("code"))
    each = issues.groupBy("code", "prediction_key").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("code").agg(F.sum("n").alias("issues"), F.count(F.lit(1)).alias("samples"))


@query("variant_finish", "WITH p AS (SELECT DISTINCT prediction_key, variant, finish_reason, prompt_tokens, completion_tokens FROM predictions) SELECT variant, coalesce(finish_reason, 'unknown') AS finish_reason, count(*) AS predictions, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS tokens, count(*) FILTER (completion_tokens IS NULL) AS without_usage FROM p GROUP BY 1, 2")
def variant_finish(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions, tokens and missing usage by variant and finish reason."""
    rows = table(spark, folder, "predictions").select("prediction_key", "variant", "finish_reason", "prompt_tokens", "completion_tokens").distinct()
    return rows.groupBy("variant", F.coalesce("finish_reason", F.lit("unknown")).alias("finish_reason")).agg(F.count(F.lit(1)).alias("predictions"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("completion_tokens").isNull()).alias("without_usage"))


@query("limit_first", "SELECT DISTINCT event_id FROM events ORDER BY event_id LIMIT 100")
def limit_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred events in order of commitment."""
    return table(spark, folder, "events").select("event_id").distinct().orderBy("event_id").limit(100)


@query("dataset_signature", DOCS_SQL + " SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(sha256(doc_id || '|' || grp), 1, 12)) AS BIGINT)) AS DECIMAL(38,0)) AS signature FROM docs")
def dataset_signature(spark: SparkSession, folder: str) -> DataFrame:
    """A signature of the rows that doesn't depend on their order: the sum of their digests' first 48 bits."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", "doc_id", "grp"), 256), 1, 12), 16, 10).cast("decimal(28,0)")
    return _docs(spark, folder).agg(F.count(F.lit(1)).alias("rows"), F.sum(digest).cast("decimal(38,0)").alias("signature"))


@query("squeeze_titles", "SELECT coalesce(nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), ''), 'untitled') AS title, count(*) AS documents FROM documents GROUP BY 1")
def squeeze_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by title, spacing aside."""
    title = F.coalesce(F.nullif(squeeze(F.col("title")), F.lit("")), F.lit("untitled"))
    return table(spark, folder, "documents").groupBy(title.alias("title")).agg(F.count(F.lit(1)).alias("documents"))


@query("source_shares", "SELECT source, count(*) AS documents, CAST(ntile(4) OVER (ORDER BY count(*), source) AS INTEGER) AS quarter FROM documents WHERE source IS NOT NULL GROUP BY 1")
def source_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with their documents and the quarter they are in by size; the ranking is over sources, not documents."""
    counted = table(spark, folder, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return counted.withColumn("quarter", F.ntile(4).over(Window.orderBy("documents", "source")))



@query("run_attempts")
def run_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts, tokens and missing usage of the runs, by the status of the last attempt."""
    from tessera.sources import runs

    each = runs.reported(runs.attempts_of(table(spark, folder, "run_records")))
    return each.groupBy("last_status").agg(F.count(F.lit(1)).alias("runs"), F.sum("attempts").alias("attempts"), F.sum("tokens").alias("tokens"), F.sum("without_usage").alias("without_usage"))
