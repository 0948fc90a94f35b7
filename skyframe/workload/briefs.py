"""Queries: grounding records and checks of generated texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.functions.text import bounded_text
from skyframe.operators import briefs as B
from skyframe.session import text_batches
from skyframe.workload import views as V
from skyframe.workload.registry import query
from skyframe.workload.selection import GROUNDED, GROUNDING_PROBLEM, grounded
from skyframe.workload.views import CONJUNCTIONS, ELEMENTS, OBJECTS, RUNS, with_views


def brief_texts(spark, folder):
    """One generated brief per document: its whole text, in varying shapes."""
    documents, labels = V.table(spark, folder, "documents"), V.table(spark, folder, "labels")
    key = F.col("doc_id")
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    lead = F.when(key % 3 == 0, "The primary object nears the secondary object. ").otherwise("Objects. ")
    summary = F.concat(lead, F.when(key % 4 == 0, "High risk of contact remains. ").otherwise(""), F.col("text"))
    evidence = F.when(key % 7 == 0, listed(["tca", "tca", "method"])).otherwise(listed(["miss_distance_km"]))
    checks = F.when(key % 6 == 0, listed(K.BRIEF_RECOMMENDED_CHECKS[:2] + K.BRIEF_RECOMMENDED_CHECKS[:1])).when(
        key % 6 == 1, listed(["unheard_of"])
    ).otherwise(listed(K.BRIEF_RECOMMENDED_CHECKS[:1]))
    observation = F.struct(F.concat(F.lit("Doc "), F.translate(F.col("source"), "0123456789", "abcdefghij"), F.lit(" keeps distance.")).alias("text"), evidence.alias("evidence_fields"))
    brief = F.to_json(
        F.struct(
            summary.alias("executive_summary"),
            F.array(observation).alias("key_observations"),
            checks.alias("recommended_checks"),
            listed(K.BRIEF_LIMITATIONS[:1]).alias("limitations"),
        )
    )
    content = (
        F.when(key % 19 == 0, F.col("text"))
        .when(key % 19 == 1, F.concat(F.lit("<THINK>"), F.col("text")))
        .when(key % 19 == 2, "  ")
        .otherwise(brief)
    )
    quality = labels.select("doc_id", "quality")
    return documents.join(quality, "doc_id", "left").select(
        key.alias("brief_id"),
        content.alias("content"),
        F.when(F.col("quality") == 0, "length").when(key % 23 == 5, "other").otherwise("stop").alias("finish_reason"),
        F.when(key % 29 == 3, "because").alias("reasoning_content"),
        (F.col("n_chars") / 4).cast("int").alias("prompt_tokens"),
        F.lit(100).alias("completion_tokens"),
        F.when(key % 9 == 0, listed(["tca", "method"])).otherwise(listed(K.BRIEF_EVIDENCE_FIELDS)).alias("available"),
        F.lower("source").alias("source"),
        "text",
        checks.alias("recommended_checks"),
        listed(K.BRIEF_LIMITATIONS[:1] * 2).alias("limitations"),
    )


BRIEF_COLUMNS = (
    "brief_id", "content", "finish_reason", "reasoning_content", "prompt_tokens", "completion_tokens", "available",
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _plain_risks() -> dict[str, tuple[str, str]]:
    """For each pattern that looks around, (all phrases, phrases in a setting that
    excuses them) as plain patterns: it finds something where the first occur more often."""
    maneuver = K.MANEUVER_PATTERN.replace("(?<!not )", "")
    excused = K.MANEUVER_PATTERN.replace("(?i)\\b(?:perform|execute|initiate|conduct|schedule|prescribe|", "(?i)\\bnot (?:").replace(
        "(?<!not )", "").replace("|should|must)", ")").replace("|\\balter (?:the )?orbit\\b", "")
    probability = K.PROBABILITY_PATTERN.replace("(?<!no )", "").replace("(?!not\\b|unknown\\b|unavailable\\b)", "")
    said = r"(?:collision probability|probability of collision)\s+(?:is|appears|remains|equals|was)\s+"
    excused_probability = rf"(?i)\bno {said}|{said}(?:not\b|unknown\b|unavailable\b)"
    return {"maneuver": (maneuver, excused), "probability": (probability, excused_probability)}


def _more(name: str) -> str:
    every, excused = _plain_risks()[name]
    return f"len(regexp_extract_all(summary, {_quoted(every)})) > len(regexp_extract_all(summary, {_quoted(excused)}))"


BRIEFS = f"""written AS (
  SELECT d.doc_id AS brief_id, d.text, l.quality, d.doc_id AS k, d.source,
    CASE WHEN d.doc_id % 3 = 0 THEN 'The primary object nears the secondary object. ' ELSE 'Objects. ' END
      || CASE WHEN d.doc_id % 4 = 0 THEN 'High risk of contact remains. ' ELSE '' END || d.text AS summary
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
contents AS (
  SELECT *, CASE WHEN quality = 0 THEN 'length' WHEN k % 23 = 5 THEN 'other' ELSE 'stop' END AS finish,
    CASE k % 19 WHEN 0 THEN text WHEN 1 THEN '<THINK>' || text WHEN 2 THEN '  ' ELSE
      '{{"executive_summary":' || to_json(summary)::VARCHAR || ',"key_observations":[{{"text":"Doc '
        || translate(source, '0123456789', 'abcdefghij') || ' keeps distance.","evidence_fields":'
        || CASE WHEN k % 7 = 0 THEN '["tca","tca","method"]' ELSE '["miss_distance_km"]' END || '}}],"recommended_checks":'
        || CASE k % 6 WHEN 0 THEN '["verify_ephemeris_freshness","review_event_evolution","verify_ephemeris_freshness"]'
          WHEN 1 THEN '["unheard_of"]' ELSE '["verify_ephemeris_freshness"]' END
        || ',"limitations":["ai_explanation_not_orbital_calculation"]}}' END AS content FROM written),
verdicts AS (SELECT *, CASE
    WHEN k % 29 = 3 THEN ['reasoning_present', 'reasoning_content']
    WHEN finish = 'length' THEN ['output_truncated', 'finish_reason']
    WHEN finish <> 'stop' THEN ['finish_reason_invalid', 'finish_reason']
    WHEN NOT regexp_matches(content, '\\S') THEN ['empty_content', 'content']
    WHEN regexp_matches(content, '(?i)</?think\\b') THEN ['thinking_tag_present', 'content']
    WHEN k % 19 = 0 THEN ['invalid_json', 'content']
    WHEN k % 6 = 1 OR length(summary) NOT BETWEEN 20 AND 320 THEN ['schema_invalid', 'content']
    WHEN regexp_matches(summary, '\\p{{Nd}}') THEN ['narrative_digit', 'narrative']
    WHEN {_more("maneuver")} THEN ['maneuver_instruction', 'narrative']
    WHEN {_more("probability")} THEN ['invented_probability', 'narrative']
    WHEN regexp_matches(summary, {_quoted(K.RISK_PATTERN)}) THEN ['invented_risk_classification', 'narrative']
    WHEN NOT (contains(lower(summary), 'primary object') AND contains(lower(summary), 'secondary object'))
      THEN ['schema_invalid', 'narrative']
    WHEN k % 9 = 0 AND k % 7 <> 0 THEN ['unavailable_evidence', 'key_observations.evidence_fields'] END AS verdict
  FROM contents)"""


@query(with_views(BRIEFS) + "SELECT brief_id, verdict[1] AS reason, verdict[2] AS field_path FROM verdicts")
def brief_checks(spark, folder):
    """The first failing check of each brief. The oracle counts phrases with and without
    the setting that excuses them, as its patterns cannot look around."""
    checked = B.check_briefs(brief_texts(spark, folder).select(*BRIEF_COLUMNS))
    return checked.select("brief_id", "reason", "field_path")


@query(
    with_views(BRIEFS)
    + """SELECT brief_id, verdict[1] AS reason, verdict[2] AS field_path,
      CASE WHEN finish = 'other' THEN 'unknown' ELSE finish END AS finish_reason,
      floor(length(text) / 4)::INTEGER AS prompt_tokens, 100::INTEGER AS completion_tokens, sha256(content) AS output_sha256
    FROM verdicts WHERE verdict IS NOT NULL"""
)
def brief_rejections(spark, folder):
    return B.rejections(B.check_briefs(brief_texts(spark, folder).select(*BRIEF_COLUMNS)))


RISK_SQL = K.RISK_PATTERN.replace("'", "''")


@query(
    f"""SELECT doc_id, NOT regexp_matches(text, '\\S') AS blank, regexp_matches(text, '\\p{{Nd}}') AS digit,
      regexp_matches(text, '{RISK_SQL}') AS risk, regexp_matches(text, '(?i)</?think\\b') AS think_tag,
      length(text) BETWEEN 20 AND 320 AS summary_length, length(text) BETWEEN 15 AND 180 AS observation_length,
      sha256(text) AS output_sha256 FROM documents"""
)
def brief_text_checks(spark, folder):
    """The checks a plain SQL engine can repeat, over whole documents."""
    documents, text = V.table(spark, folder, "documents"), F.col("text")
    checks = B.narrative_checks(F.array(text))
    return documents.select(
        "doc_id",
        checks[0].alias("blank"),
        checks[1].alias("digit"),
        checks[4].alias("risk"),
        text.rlike(K.THINK_TAG_PATTERN).alias("think_tag"),
        F.length(text).between(*K.BRIEF_SUMMARY_CHARS).alias("summary_length"),
        F.length(text).between(*K.BRIEF_OBSERVATION_CHARS).alias("observation_length"),
        F.sha2(text, 256).alias("output_sha256"),
    )


@query(
    """WITH lists AS (SELECT doc_id, CASE doc_id % 6
        WHEN 0 THEN ['verify_ephemeris_freshness', 'review_event_evolution', 'verify_ephemeris_freshness']
        WHEN 1 THEN ['unheard_of'] ELSE ['verify_ephemeris_freshness'] END AS checks FROM documents)
    SELECT doc_id AS brief_id, array_to_string(CASE WHEN doc_id % 6 = 0 THEN checks[1:2] ELSE checks END, ',') AS checks,
      'ai_explanation_not_orbital_calculation' AS limitations,
      (CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END)::INTEGER AS removed_recommended_checks,
      1::INTEGER AS removed_limitations FROM lists"""
)
def enum_dedupe(spark, folder):
    rows = B.dedupe_lists(brief_texts(spark, folder))
    return rows.select(
        "brief_id",
        F.array_join("recommended_checks", ",").alias("checks"),
        F.array_join("limitations", ",").alias("limitations"),
        "removed_recommended_checks",
        "removed_limitations",
    )


@query(
    """SELECT doc_id, length(reply) BETWEEN 1 AND 300 AND status = 'ok'
        AND NOT regexp_matches(lower(reply), '</?think>') AS valid
    FROM (SELECT doc_id, text AS reply, CASE WHEN doc_id % 4 = 0 THEN 'bad' ELSE 'ok' END AS status FROM documents)"""
)
def reply_checks(spark, folder):
    documents, key = V.table(spark, folder, "documents"), F.col("doc_id")
    reply = F.to_json(
        F.struct(F.when(key % 4 == 0, "bad").otherwise("ok").alias("status"), F.col("text").alias("summary"))
    )
    return documents.select("doc_id", B.reply_valid(reply).alias("valid"))


def _facts(spark, folder):
    """Grounded events with times as text, ready for the model's view."""
    rows = grounded(spark, folder)
    times = ("primary_element_epoch", "secondary_element_epoch", "tca", "window_start", "window_end", "run_completed_at")
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in times})


@query(
    with_views(OBJECTS, ELEMENTS, CONJUNCTIONS, RUNS, GROUNDED)
    + """SELECT event_id, 15 - (primary_object_type IS NULL)::INTEGER - (secondary_object_type IS NULL)::INTEGER
        - 2 * (primary_owner IS NULL)::INTEGER - 2 * (secondary_owner IS NULL)::INTEGER AS available_fields FROM grounded"""
)
def evidence_fields(spark, folder):
    view = B.model_view(_facts(spark, folder))
    return view.select("event_id", F.size(B.available_evidence()).alias("available_fields"))


@query(
    with_views(OBJECTS, ELEMENTS, CONJUNCTIONS, RUNS, GROUNDED)
    + f"""SELECT event_id, json, sha256(json) AS digest FROM (SELECT event_id,
      '{{"event_id":' || event_id::VARCHAR || ',"primary_element_source":"' || primary_element_source
      || '","primary_object_type":' || coalesce('"' || primary_object_type || '"', 'null')
      || ',"run_id":' || run_id::VARCHAR || '}}' AS json FROM grounded WHERE ({GROUNDING_PROBLEM}) IS NULL)"""
)
def grounding_digest(spark, folder):
    columns = ["run_id", "event_id", "primary_object_type", "primary_element_source"]
    rows = grounded(spark, folder).filter("problem IS NULL")
    return rows.select(
        "event_id", B.canonical_json(columns).alias("json"), B.grounding_digest(columns).alias("digest")
    )


@query(
    """SELECT doc_id, nullif(trim(substring(trim(regexp_replace(regexp_replace(nfc_normalize(text), '\\p{C}', '', 'g'),
      '\\s+', ' ', 'g')), 1, 255)), '') AS bounded FROM documents"""
)
def bounded_texts(spark, folder):
    """Whole documents made fit for grounding. The given documents hold no character that
    compatibility normalisation replaces, so canonical normalisation is their oracle."""
    text_batches(spark)
    documents = V.table(spark, folder, "documents")
    return documents.select("doc_id", bounded_text(F.col("text"), 255).alias("bounded"))
