"""Queries of sources and sinks: what is written to the shared folder and read back must be what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.decode import decoded
from tessera.functions.text import prompt_group
from tessera.operators import admission, curate, generate, windows
from tessera.plans.curation import HOLDOUT_SQL, folded_sql
from tessera.runtime import new_folder
from tessera.sources import documents, runs, sinks
from tessera.sources.tables import table
from tessera.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query with its SQL."""

    def keep(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return keep


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    """One prompt for each normalised form, the one of the smallest id; without blank and overlong ones."""
    rows = table(spark, folder, "prompt_specs").where("id IS NOT NULL AND trim(prompt) <> '' AND char_length(prompt) <= 8000").select("id", "theme", "prompt", prompt_group(F.col("prompt")).alias("grp"))
    first = rows.groupBy("grp").agg(F.min("id").alias("id"))
    return rows.dropDuplicates(["id"]).join(first, ["id", "grp"], "left_semi").select("id", "theme", "prompt")


_UNIQUE = "WITH " + folded_sql("SELECT prompt AS t FROM prompt_specs") + ", firsts AS (SELECT min(id) AS id FROM prompt_specs JOIN normed ON prompt = t WHERE id IS NOT NULL AND trim(prompt) <> '' AND length(prompt) <= 8000 GROUP BY norm)"


@query("source_inventory", _UNIQUE + " SELECT DISTINCT id, theme, prompt FROM prompt_specs WHERE id IN (SELECT id FROM firsts)")
def source_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """An inventory written as JSON lines and read back under its rules: unique ids and normalised prompts, bounded lengths."""
    place = new_folder(spark, "inventory")
    sinks.write_lines(_prompts(spark, folder), place)
    return documents.prompts(spark, place).select("id", "theme", "prompt")


@query("source_inventory_first", _UNIQUE + " SELECT id FROM firsts ORDER BY id LIMIT 50")
def source_inventory_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty prompts of the inventory; a shortfall would be an error."""
    return documents.first(_prompts(spark, folder).select("id"), "id", 50)


@query("source_lines", "SELECT DISTINCT message_key, id, turn, role, content FROM messages")
def source_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as JSON lines and back, whatever line marks stand within their texts."""
    rows = table(spark, folder, "messages").select("message_key", "id", "turn", "role", "content").distinct()
    place = new_folder(spark, "lines")
    sinks.write_lines(rows, place)
    return documents.read_lines(spark, place, rows.schema)


@query("source_protected", "WITH " + folded_sql("SELECT text AS t FROM eval_items") + " SELECT DISTINCT sha256(norm) AS grp FROM normed")
def source_protected(spark: SparkSession, folder: str) -> DataFrame:
    """The registry of protected prompts, from files of items as prompts."""
    place = new_folder(spark, "protected")
    sinks.write_lines(table(spark, folder, "eval_items").where("text IS NOT NULL").select(F.col("text").alias("prompt")), place)
    return documents.protected_groups(spark, [place])


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    """Runs as samples, one for each case: the last finished one, with the split of its case."""
    found = table(spark, folder, "run_records").where("case_id IS NOT NULL").groupBy(F.col("case_id").alias("id")).agg(F.max(F.struct(F.col("finished_at").isNotNull(), "finished_at", "run_id", F.coalesce("status", F.lit("interrupted")).alias("status"))).alias("r"))
    bucket = F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long") % 10
    split = F.when(bucket < 8, "train").when(bucket == 8, "val").otherwise("test")
    return found.select("id", split.alias("split"), F.col("r.status").alias("status"), F.col("r.run_id").alias("run_id"))


_SAMPLES = """WITH last AS (SELECT case_id AS id, coalesce(status, 'interrupted') AS status, run_id, row_number() OVER (PARTITION BY case_id ORDER BY (finished_at IS NOT NULL) DESC, finished_at DESC, run_id DESC, coalesce(status, 'interrupted') DESC) AS k FROM run_records WHERE case_id IS NOT NULL),
samples AS (SELECT id, status, run_id, CASE WHEN CAST('0x' || substr(sha256(id), 1, 8) AS BIGINT) % 10 < 8 THEN 'train' WHEN CAST('0x' || substr(sha256(id), 1, 8) AS BIGINT) % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM last WHERE k = 1)"""


@query("sink_snapshot", _SAMPLES + " SELECT split AS file, id FROM samples WHERE status = 'success' UNION ALL SELECT CASE WHEN status = 'success' THEN 'valid' ELSE 'failed' END, id FROM samples UNION ALL SELECT 'membership', id FROM samples WHERE status = 'success'")
def sink_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a snapshot with the ids in each, as read back."""
    place = new_folder(spark, "snapshot")
    made = sinks.export_snapshot(_samples(spark, folder), place)
    shape = T.StructType([T.StructField("id", T.StringType())])
    parts = [documents.read_lines(spark, f"{place}/{name}", shape).select(F.lit(name).alias("file"), "id") for name in made]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("sink_snapshot_rows", _SAMPLES + " SELECT file, CAST(count(id) AS BIGINT) AS rows FROM (SELECT unnest(['train','val','test','valid','failed','membership']) AS file) LEFT JOIN (SELECT split AS f, id FROM samples WHERE status = 'success' UNION ALL SELECT CASE WHEN status = 'success' THEN 'valid' ELSE 'failed' END, id FROM samples UNION ALL SELECT 'membership', id FROM samples WHERE status = 'success') ON file = f GROUP BY 1")
def sink_snapshot_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each file of a snapshot, from its manifest."""
    made = sinks.export_snapshot(_samples(spark, folder), new_folder(spark, "snapshot"))
    return spark.createDataFrame([(name, about["rows"]) for name, about in made.items()], "file string, rows long")


@query("sink_routed", _SAMPLES + " SELECT CASE WHEN status = 'success' THEN 'valid' ELSE 'failed' END AS outcome, status, count(*) AS samples FROM samples GROUP BY 1, 2")
def sink_routed(spark: SparkSession, folder: str) -> DataFrame:
    """Samples routed to folders by outcome, rebuilt and read back."""
    place = new_folder(spark, "routed")
    rows = _samples(spark, folder)
    sinks.append_routed(rows, place)
    sinks.rebuild_routed(rows, place)
    return spark.read.parquet(place).groupBy("outcome", "status").agg(F.count(F.lit(1)).alias("samples"))


@query("sink_export", "WITH turns AS (SELECT id, turn, arg_min({'role': role, 'content': content}, message_key) AS m FROM messages WHERE id IS NOT NULL GROUP BY 1, 2), chats AS (SELECT id, list(m ORDER BY turn) AS ms FROM turns GROUP BY 1) SELECT CASE WHEN CAST('0x' || substr(sha256(id), 1, 8) AS BIGINT) % 10 < 8 THEN 'train' ELSE 'validation' END AS split, ms[2].content AS instruction, ms[3].content AS output, ms[1].content AS system FROM chats WHERE list_transform(ms, lambda m: m.role) = ['system', 'user', 'assistant']")
def sink_export(spark: SparkSession, folder: str) -> DataFrame:
    """Training files in the instruction form, by split, as read back."""
    place = new_folder(spark, "export")
    chats = curate.chats(table(spark, folder, "messages")).where(curate.is_training_chat())
    split = F.when(F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long") % 10 < 8, "train").otherwise("validation")
    samples = chats.select("id", F.sha2("id", 256).alias("prompt_group"), split.alias("split"), "messages")
    sinks.export(samples, place)
    shape = T.StructType([T.StructField(c, T.StringType()) for c in ("instruction", "output", "system", "split")])
    return spark.read.schema(shape).json(f"{place}/alpaca").select("split", "instruction", "output", "system")


@query(
    "sink_runs",
    """WITH rows AS (SELECT DISTINCT prediction_key, id, raw_response, error, provider FROM predictions WHERE id IS NOT NULL AND prediction_key IS NOT NULL),
last AS (SELECT *, max(prediction_key) OVER (PARTITION BY id) AS last FROM rows)
SELECT id AS run_id, count(*) AS attempts, CASE WHEN count(*) FILTER (prediction_key = last AND coalesce(error, '') <> '') = 0 THEN 'success' ELSE 'invalid' END AS status, sha256(string_agg(sha256(coalesce(raw_response, '')), ',' ORDER BY prediction_key)) AS sha256 FROM last GROUP BY 1""",
)
def sink_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Audited runs, the predictions of an id being the attempts: their number, how the last one ended, the digest over all."""
    place = new_folder(spark, "runs")
    rows = table(spark, folder, "predictions").where("id IS NOT NULL AND prediction_key IS NOT NULL").select("prediction_key", "id", "raw_response", "error", "provider").distinct()
    issues = F.when(F.coalesce("error", F.lit("")) != "", F.array("error")).otherwise(F.array().cast("array<string>"))
    sinks.write_runs(rows.select(F.col("id").alias("run_id"), F.col("prediction_key").alias("number"), F.lit(None).cast("string").alias("request"), F.col("raw_response").alias("response"), issues.alias("issues"), "provider"), place)
    return spark.read.parquet(f"{place}/runs")


# Attempts as a state log: a prediction opens its case and, unless it has an error, ends it.
_STATES = "WITH log AS (SELECT DISTINCT id, 2 * prediction_key AS seq, 'running' AS state FROM predictions WHERE id IS NOT NULL UNION ALL SELECT DISTINCT id, 2 * prediction_key + 1, 'finished' FROM predictions WHERE id IS NOT NULL AND error IS NULL)"


def _states(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "predictions").where("id IS NOT NULL").select("id", "prediction_key", "error").distinct()
    begins = rows.select("id", (2 * F.col("prediction_key")).alias("seq"), F.lit("running").alias("state"))
    return begins.unionByName(rows.where("error IS NULL").select("id", (2 * F.col("prediction_key") + 1).alias("seq"), F.lit("finished").alias("state")))


@query("log_illegal", _STATES + ", marked AS (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY seq) AS before FROM log) SELECT id, state, seq FROM marked WHERE CASE WHEN state = 'running' THEN before IS NOT NULL ELSE coalesce(before <> 'running', true) END")
def log_illegal(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of a state log that may not follow what came before."""
    return ingest.illegal_transitions(_states(spark, folder))


@query("log_interrupted", _STATES + " SELECT id, 'interrupted' AS state FROM log GROUP BY 1 HAVING arg_max(state, seq) = 'running'")
def log_interrupted(spark: SparkSession, folder: str) -> DataFrame:
    """Cases that a broken run has left running."""
    return ingest.recover(_states(spark, folder))


@query("log_pending", _STATES + " SELECT DISTINCT id FROM messages WHERE id NOT IN (SELECT id FROM log) AND id IS NOT NULL")
def log_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Cases that the log says nothing about."""
    return ingest.pending(table(spark, folder, "messages").where("id IS NOT NULL").select("id").distinct(), _states(spark, folder))


@query("log_snapshot", _STATES + ", last AS (SELECT id, arg_max(state, seq) AS state, max(seq) AS seq FROM log GROUP BY 1) SELECT id, seq FROM last WHERE state = 'finished' ORDER BY seq LIMIT 50")
def log_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty finished cases in order of commitment."""
    return documents.snapshot(_states(spark, folder), 50).select("id", "seq")


@query("gate_paths", "SELECT prompt AS path, NOT (prompt = '' OR regexp_matches(prompt, '^([/\\\\]|[A-Za-z]:)') OR list_contains(regexp_split_to_array(prompt, '[/\\\\]+'), '..')) AS contained FROM (SELECT DISTINCT CASE ascii(id) % 4 WHEN 0 THEN '/' || theme WHEN 1 THEN theme || '/../' || source ELSE theme || '/' || source END AS prompt FROM prompt_specs WHERE theme IS NOT NULL AND source IS NOT NULL)")
def gate_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that stay below the folder they are relative to."""
    kind = F.ascii("id") % 4
    path = F.when(kind == 0, F.concat(F.lit("/"), "theme")).when(kind == 1, F.concat("theme", F.lit("/../"), "source")).otherwise(F.concat("theme", F.lit("/"), "source"))
    rows = table(spark, folder, "prompt_specs").where("theme IS NOT NULL AND source IS NOT NULL").select(path.alias("path")).distinct()
    return rows.select("path", admission.is_contained(F.col("path")).alias("contained"))


@query("gate_checksum", "SELECT doc_id, doc_id % 3 > 0 AS good FROM documents WHERE text IS NOT NULL")
def gate_checksum(spark: SparkSession, folder: str) -> DataFrame:
    """Texts whose recorded digest (here wrong in every third) is that of their bytes."""
    recorded = F.upper(F.sha2(F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise(F.concat("text", F.lit("x"))), 256))
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", admission.checksum_ok(F.encode("text", "UTF-8"), recorded).alias("good"))


@query("gate_response", "SELECT DISTINCT prediction_key, CASE WHEN error IS NOT NULL AND contains(error, 'declined') THEN 'refusal' WHEN finish_reason IS DISTINCT FROM 'stop' THEN 'unfinished' WHEN raw_response IS NULL OR NOT regexp_matches(raw_response, '[^\\s\\x0b\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]') THEN 'empty' ELSE 'accepted' END AS verdict FROM predictions")
def gate_response(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a provider's response is taken, or why not."""
    refusal = F.when(F.contains("error", F.lit("declined")), F.col("error"))
    rows = table(spark, folder, "predictions").select("prediction_key", F.coalesce(runs.accepted_response(F.col("finish_reason"), F.col("raw_response"), refusal), F.lit("accepted")).alias("verdict"))
    return rows.distinct()


@query("dedup_greedy", None)
def dedup_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts accepted in order of their ids, each unless its group or its source with theme was accepted before."""
    rows = table(spark, folder, "prompt_specs").where("id IS NOT NULL AND prompt IS NOT NULL").dropDuplicates(["id"]).select("id", prompt_group(F.col("prompt")).alias("grp"), F.sha2(F.concat_ws("|", "source", "theme", F.substring("prompt", 1, 1)), 256).alias("fingerprint"))
    return generate.greedy_distinct(rows, "id", ("grp", "fingerprint"))


@query("curriculum_outcomes", HOLDOUT_SQL + ", c AS (SELECT id AS seq, grp, sha256(id) AS fingerprint FROM prompts), r AS (SELECT *, CASE WHEN grp IN (SELECT grp FROM held) THEN 'protected_prompt' WHEN substr(fingerprint, 1, 1) = '0' THEN 'known_world' END AS reason, row_number() OVER (PARTITION BY grp, grp IN (SELECT grp FROM held) OR substr(fingerprint, 1, 1) = '0' ORDER BY seq) AS k FROM c) SELECT coalesce(reason, CASE WHEN k > 1 THEN 'duplicate' ELSE 'accepted' END) AS outcome, count(*) AS prompts FROM r GROUP BY 1")
def curriculum_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What a curriculum takes of the prompts, and why not the others: protected, known (here by the digest of the id), or a
    duplicate of one that was accepted before."""
    from tessera.plans.curation import _prompts as grouped

    rows, held = grouped(spark, folder)
    made = rows.select(F.col("id").alias("seq"), "grp", F.sha2("id", 256).alias("fingerprint"), F.lit(True).alias("valid"))
    good, bad = generate.curriculum(made, held, made.where("fingerprint LIKE '0%'").select("fingerprint"))
    outcomes = good.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("prompts"))


@query("gen_benchmark", "SELECT unnest(['easy','hard','medium']) AS difficulty, unnest([30, 30, 40]) AS tasks, unnest([30, 30, 40]) AS feasible, unnest([3, 9, 5]) AS objects, unnest([1, 3, 2]) AS relations")
def gen_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """A frozen benchmark of a hundred tasks by difficulty, with those whose witness is a sound world."""
    made = generate.benchmark(spark, 100, 42)
    sinks.freeze_benchmark(made, new_folder(spark, "benchmark"))
    judged = decoded(made, "witness")
    return judged.groupBy("difficulty").agg(F.count(F.lit(1)).cast("int").alias("tasks"), F.count_if("schema_ok").cast("int").alias("feasible"), F.max("objects").alias("objects"), F.max("relations").alias("relations"))


@query("strict_json", "SELECT DISTINCT prediction_key, coalesce(json_valid(raw_response) AND NOT regexp_matches(raw_response, ',\\s*[]}]'), false) AS json_ok FROM predictions WHERE prediction_key IS NOT NULL")
def strict_json(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each answer is JSON with nothing around it."""
    rows = table(spark, folder, "predictions").where("prediction_key IS NOT NULL").select("prediction_key", "raw_response").dropDuplicates(["prediction_key"])
    return decoded(rows, "raw_response").select("prediction_key", "json_ok")


#: A document for each order, with a fault by its key, and the verdict that each must have.
_FAULTS = (
    ("none", "", ""), ("NaN", ', "relations": [NaN]', "json_invalid"), ("infinity", ', "map": {"width": -Infinity}', "json_invalid"), ("overflow", ', "map": {"width": 1e999}', "int_type"),
    ("member", ', "extra": 1', "extra_forbidden"), ("biome", ', "map": {"biome": "sea"}', "literal_error"), ("side", ', "map": {"height": 7}', "greater_than_equal"), ("version", ', "schema_version": "2.0"', "literal_error"),
    ("relation", ', "relations": [{"relation_type": "near", "source": "a_1"}]', "missing"), ("cut", ', "relations": [', "json_invalid"),
)


@query("strict_planted", "SELECT fault, code, count(*) AS documents FROM (SELECT " + " ".join(["CASE o_orderkey % 10", *(f"WHEN {i} THEN '{f[0]}'" for i, f in enumerate(_FAULTS)), "END"]) + " AS fault, " + " ".join(["CASE o_orderkey % 10", *(f"WHEN {i} THEN '{f[2]}'" for i, f in enumerate(_FAULTS)), "END"]) + " AS code FROM orders) GROUP BY 1, 2")
def strict_planted(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a planted fault each, by the fault and by the codes strict decoding gives them."""
    key = F.col("o_orderkey")
    fault = F.get(F.array(*[F.lit(f[0]) for f in _FAULTS]), (key % 10).cast("int"))
    text = F.get(F.array(*[F.lit(f[1]) for f in _FAULTS]), (key % 10).cast("int"))
    head = F.format_string('{"scene": "order_%d", "objects": [{"object_type": "house", "id": "a_1", "position": [%d, 3]}]', key, key % 100)
    end = F.when(key % 10 == 9, "").otherwise("}")
    made = decoded(table(spark, folder, "orders").select(fault.alias("fault"), F.concat(head, text, end).alias("raw")), "raw")
    return made.select("fault", F.array_join("schema_issues.code", ",").alias("code")).groupBy("fault", "code").agg(F.count(F.lit(1)).alias("documents"))


# Chats as tokens: four characters each, numbered by their digest; windows by the settings of the profile.
_CHATS = """WITH turns AS (SELECT id, turn, arg_min({'role': role, 'content': content, 'profile': profile}, message_key) AS m FROM messages WHERE id IS NOT NULL GROUP BY 1, 2),
chats AS (SELECT id, list(m ORDER BY turn) AS ms FROM turns GROUP BY 1),
good AS (SELECT id, ms[1].content AS s, ms[2].content AS u, ms[3].content AS a, ms[1].profile AS profile FROM chats WHERE list_transform(ms, lambda m: m.role) = ['system', 'user', 'assistant']),
sized AS (SELECT id, coalesce(profile, (SELECT min(profile) FROM train_settings WHERE is_default)) AS profile, CAST(ceil(length(coalesce(s, '')) / 4.0) + ceil(length(coalesce(u, '')) / 4.0) AS INTEGER) AS start, CAST(ceil(length(coalesce(s, '')) / 4.0) + ceil(length(coalesce(u, '')) / 4.0) + ceil(length(coalesce(a, '')) / 4.0) AS INTEGER) AS n FROM good),
given AS (SELECT id, start, n, max_seq_length AS m, overlap_tokens AS o, long_sequence_policy AS p FROM sized LEFT JOIN train_settings t USING (profile)),
judged AS (SELECT *, CASE WHEN NOT coalesce(start > 0 AND start < n, false) THEN 'the answer doesn''t begin within the tokens' WHEN NOT coalesce(o >= 1 AND o < m, false) THEN 'the overlap isn''t between one and the length' WHEN NOT coalesce(p IN ('chunk_assistant', 'error'), false) THEN 'the policy is unknown' WHEN p = 'error' AND n > m THEN 'the sequence is longer than a window' END AS error FROM given),
each AS (SELECT *, unnest(range(1 + CAST(ceil(greatest(n - m, 0) / CAST(m - o AS DOUBLE)) AS BIGINT))) AS k FROM judged WHERE error IS NULL),
placed AS (SELECT *, k * (m - o) AS b, least(k * (m - o) + m, n) AS z, greatest(start, CASE WHEN k = 0 THEN 0 ELSE k * (m - o) + o END, k * (m - o) + 1) AS f FROM each)"""


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "messages").where("id IS NOT NULL").groupBy("id", "turn").agg(F.min_by(F.struct("role", "content", "profile"), "message_key").alias("m"))
    chats = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("t")).withColumn("messages", F.transform("t", lambda x: x["m"]))
    chats = chats.where(curate.is_training_chat())
    # A token is four characters, numbered by the first 28 bits of their digest.
    token = lambda c: F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("int")
    encoded = lambda i: F.transform(F.regexp_extract_all(F.coalesce(F.get("messages", F.lit(i))["content"], F.lit("")), F.lit(r"(?s).{1,4}"), F.lit(0)), token)
    settings = table(spark, folder, "train_settings").where("profile IS NOT NULL")
    default = settings.where("is_default").agg(F.min("profile")).first()[0]
    made = chats.select("id", F.coalesce(F.get("messages", F.lit(0))["profile"], F.lit(default)).alias("profile"), encoded(0).alias("s"), encoded(1).alias("u"), encoded(2).alias("a"))
    made = made.select("id", "profile", F.concat("s", "u", "a").alias("ids"), (F.size("s") + F.size("u")).alias("start"))
    joined = made.join(settings.select("profile", "max_seq_length", "overlap_tokens", "long_sequence_policy"), "profile", "left")
    return windows.assistant_windows(joined, "ids", "start", F.col("max_seq_length"), F.col("overlap_tokens"), F.col("long_sequence_policy"), strict=False)


@query("token_windows", _CHATS + " SELECT id, count(*) AS windows, CAST(sum(z - f) AS BIGINT) AS labelled, CAST(max(z - b) AS INTEGER) AS longest FROM placed WHERE f < z GROUP BY 1")
def token_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of each chat's tokens by the settings of its profile: their number, labelled tokens, the longest."""
    made = _windows(spark, folder).where("error IS NULL")
    labelled = F.size(F.filter("labels", lambda x: x != windows.UNLABELLED))
    return made.groupBy("id").agg(F.count(F.lit(1)).alias("windows"), F.sum(labelled.cast("long")).alias("labelled"), F.max(F.size("input_ids")).alias("longest"))


@query("token_refused", _CHATS + " SELECT id, error FROM judged WHERE error IS NOT NULL")
def token_refused(spark: SparkSession, folder: str) -> DataFrame:
    """Chats that can't be parted, and why."""
    return _windows(spark, folder).where("error IS NOT NULL").select("id", "error")


@query("token_stats", _CHATS + ", per AS (SELECT id, count(*) AS windows, sum(z - f) AS labelled, max(z - b) AS longest FROM placed WHERE f < z GROUP BY 1) SELECT count(*) AS samples, CAST(sum(windows) AS BIGINT) AS windows, count(*) FILTER (windows > 1) AS long_samples, CAST(max(longest) AS INTEGER) AS longest, CAST(sum(labelled) AS BIGINT) AS labelled FROM per")
def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Samples, windows, samples of several windows, longest window and labelled tokens over all."""
    return token_windows(spark, folder).agg(F.count(F.lit(1)).alias("samples"), F.sum("windows").alias("windows"), F.count_if(F.col("windows") > 1).alias("long_samples"), F.max("longest").alias("longest"), F.sum("labelled").alias("labelled"))


@query("batch_outcomes", "WITH last AS (SELECT case_id, max(CASE WHEN status = 'success' THEN 2 ELSE 1 END) AS s FROM run_records WHERE case_id IS NOT NULL GROUP BY 1), cases AS (SELECT DISTINCT id FROM prompt_specs WHERE id IS NOT NULL) SELECT CASE s WHEN 2 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'not run' END AS outcome, count(*) AS cases FROM cases LEFT JOIN last ON id = case_id GROUP BY 1")
def batch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of a batch that passed, failed, or were not run."""
    done = table(spark, folder, "run_records").where("case_id IS NOT NULL").groupBy(F.col("case_id").alias("id")).agg(F.max(F.coalesce(F.col("status") == "success", F.lit(False))).alias("passed"))
    joined = table(spark, folder, "prompt_specs").where("id IS NOT NULL").select("id").distinct().join(done, "id", "left")
    outcome = F.when(F.col("passed"), "passed").when(~F.col("passed"), "failed").otherwise("not run")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("cases"))
