"""Checks of generated briefs, as a batch job over a table of texts.

A brief row has ``brief_id, content, finish_reason, reasoning_content,
prompt_tokens, completion_tokens`` and ``available``: the evidence fields that its
event can support.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe import constants as K

REASONS = (
    ("reasoning_present", "reasoning_content"),
    ("output_truncated", "finish_reason"),
    ("finish_reason_invalid", "finish_reason"),
    ("empty_content", "content"),
    ("thinking_tag_present", "content"),
    ("invalid_json", "content"),
    ("schema_invalid", "content"),
    ("empty_content", "narrative"),
    ("narrative_digit", "narrative"),
    ("maneuver_instruction", "narrative"),
    ("invented_probability", "narrative"),
    ("invented_risk_classification", "narrative"),
    ("schema_invalid", "narrative"),
    ("duplicate_item", "key_observations"),
    ("unavailable_evidence", "key_observations.evidence_fields"),
)
BRIEF_KEYS = ("executive_summary", "key_observations", "recommended_checks", "limitations")


def model_view(grounded: DataFrame) -> DataFrame:
    """What a text model may see: roles instead of names, and no identifiers."""
    facts = [c for c in K.BRIEF_EVIDENCE_FIELDS if not c.endswith("_role")]
    return grounded.select(
        "event_id",
        *[
            F.lit(c.replace("_", " ").replace("role", "object")).alias(c)
            if c.endswith("_role")
            else F.col(c)
            for c in K.BRIEF_EVIDENCE_FIELDS
            if c in facts or c.endswith("_role")
        ],
    )


def available_evidence() -> Column:
    """Names of the evidence columns that hold a usable value."""
    def usable(name: str) -> Column:
        value = F.col(name)
        if name in ("miss_distance_km", "relative_velocity_km_s"):
            return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
        return value.isNotNull()

    return F.array_compact(F.array(*[F.when(usable(c), F.lit(c)) for c in K.BRIEF_EVIDENCE_FIELDS]))


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON of the columns with sorted keys, nulls written out."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def grounding_digest(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def without_repeats(values: Column, known: tuple[str, ...]) -> Column:
    """The list with later repeats of known values removed; unknown values and the
    order stay."""
    allowed = F.array(*[F.lit(v) for v in known])
    return F.filter(
        values,
        lambda v, i: ~F.array_contains(allowed, v)
        | ~F.coalesce(F.array_contains(F.slice(values, F.lit(1), i), v), F.lit(False)),
    )


def removed_repeats(values: Column, known: tuple[str, ...]) -> Column:
    return F.coalesce(F.size(values) - F.size(without_repeats(values, known)), F.lit(0))


def dedupe_lists(briefs: DataFrame) -> DataFrame:
    """Per brief the two bounded lists without repeats and how many were removed.

    ``briefs`` has array columns recommended_checks and limitations.
    """
    known = {"recommended_checks": K.BRIEF_RECOMMENDED_CHECKS, "limitations": K.BRIEF_LIMITATIONS}
    counts = {f"removed_{c}": removed_repeats(F.col(c), v) for c, v in known.items()}
    return briefs.withColumns(counts).withColumns(
        {c: without_repeats(F.col(c), v) for c, v in known.items()}
    )


def parsed_json(text: Column) -> Column:
    """A text that is one JSON value as a variant, else null.

    The parser stops behind the first value and ignores what follows. What follows a value
    cannot continue both a list and an object, so the text must fit into both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(listed.isNotNull() & named.isNotNull(), F.try_parse_json(text))


def _read(column: str, path: str, type_name: str) -> Column:
    return F.expr(f"try_variant_get({column}, '{path}', '{type_name}')")


def _kind(column: str, path: str) -> Column:
    """Variant type name of a value, null when it is absent."""
    return F.expr(f"schema_of_variant(try_variant_get({column}, '{path}', 'variant'))")


def _closed(keys: Column, expected: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_sort(keys) == F.array(*[F.lit(k) for k in sorted(expected)]), F.lit(False))


def _between(value: Column, bounds: tuple[int, int]) -> Column:
    return F.coalesce(value.between(*bounds), F.lit(False))


def _all_known(values: Column, known: tuple[str, ...]) -> Column:
    allowed = F.array(*[F.lit(v) for v in known])
    return F.coalesce(F.forall(values, lambda v: F.coalesce(F.array_contains(allowed, v), F.lit(False))), F.lit(False))


def _strings(kind: Column) -> Column:
    return F.coalesce(kind == "ARRAY<STRING>", F.lit(False))


def parse_briefs(briefs: DataFrame) -> DataFrame:
    """Adds the parsed brief: summary, observations, lists and their shapes."""
    rows = briefs.withColumn("doc", parsed_json(F.col("content")))
    rows = rows.withColumns(
        {
            "keys": F.map_keys(F.expr("try_variant_get(doc, '$', 'map<string,variant>')")),
            "summary": _read("doc", "$.executive_summary", "string"),
            "summary_kind": _kind("doc", "$.executive_summary"),
            "items": _read("doc", "$.key_observations", "array<map<string,variant>>"),
            "checks": _read("doc", "$.recommended_checks", "array<string>"),
            "checks_kind": _kind("doc", "$.recommended_checks"),
            "limits": _read("doc", "$.limitations", "array<string>"),
            "limits_kind": _kind("doc", "$.limitations"),
        }
    )
    texts = F.transform("items", lambda o: F.try_variant_get(F.try_element_at(o, F.lit("text")), "$", "string"))
    evidence = F.transform(
        "items",
        lambda o: F.try_variant_get(F.try_element_at(o, F.lit("evidence_fields")), "$", "array<string>"),
    )
    return rows.withColumns(
        {
            "item_keys": F.transform("items", lambda o: F.array_sort(F.map_keys(o))),
            "text_kinds": F.transform("items", lambda o: F.schema_of_variant(F.try_element_at(o, F.lit("text")))),
            "evidence_kinds": F.transform(
                "items", lambda o: F.schema_of_variant(F.try_element_at(o, F.lit("evidence_fields")))
            ),
            "texts": texts,
            "checks": without_repeats(F.col("checks"), K.BRIEF_RECOMMENDED_CHECKS),
            "limits": without_repeats(F.col("limits"), K.BRIEF_LIMITATIONS),
            "evidence": F.transform(evidence, lambda e: without_repeats(e, K.BRIEF_EVIDENCE_FIELDS)),
        }
    )


def _every(values: Column, test) -> Column:
    return F.coalesce(F.forall(values, lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))


def schema_valid() -> Column:
    """The closed shape of a brief: keys, types, lengths, sizes and allowed values."""
    item_shape = F.array(F.lit("evidence_fields"), F.lit("text"))
    rules = [
        _closed(F.col("keys"), BRIEF_KEYS),
        F.coalesce(F.col("summary_kind") == "STRING", F.lit(False)),
        _between(F.length("summary"), K.BRIEF_SUMMARY_CHARS),
        _between(F.size("items"), K.BRIEF_LIST_ITEMS),
        _every(F.col("item_keys"), lambda k: k == item_shape),
        _every(F.col("text_kinds"), lambda k: k == "STRING"),
        _every(F.col("texts"), lambda t: F.length(t).between(*K.BRIEF_OBSERVATION_CHARS)),
        _every(F.col("evidence_kinds"), lambda k: k == "ARRAY<STRING>"),
        _every(F.col("evidence"), lambda e: F.size(e).between(*K.BRIEF_LIST_ITEMS)),
        _all_known(F.flatten("evidence"), K.BRIEF_EVIDENCE_FIELDS),
    ]
    for name, known in (("checks", K.BRIEF_RECOMMENDED_CHECKS), ("limits", K.BRIEF_LIMITATIONS)):
        rules += [
            _strings(F.col(f"{name}_kind")),
            _between(F.size(name), K.BRIEF_LIST_ITEMS),
            _all_known(F.col(name), known),
        ]
    return reduce(lambda a, b: a & b, rules)


def narrative_checks(narratives: Column) -> list[Column]:
    """Conditions on the narrative texts, in the order in which they reject."""
    def any_text(test) -> Column:
        return F.exists(narratives, test)

    joined = F.lower(F.array_join(narratives, " "))
    return [
        any_text(lambda t: ~t.rlike(r"\S")),
        any_text(lambda t: t.rlike(r"\p{Nd}")),
        any_text(lambda t: t.rlike(K.MANEUVER_PATTERN)),
        any_text(lambda t: t.rlike(K.PROBABILITY_PATTERN)),
        any_text(lambda t: t.rlike(K.RISK_PATTERN)),
        ~F.contains(joined, F.lit("primary object")) | ~F.contains(joined, F.lit("secondary object")),
    ]


def check_briefs(briefs: DataFrame) -> DataFrame:
    """Each brief with the first failing ``reason`` and ``field_path`` in fixed order;
    both null for an accepted brief."""
    rows = parse_briefs(briefs).withColumn("valid_shape", schema_valid())
    narratives = F.concat(F.array("summary"), F.col("texts"))
    finish = F.col("finish_reason")
    conditions = [
        F.col("reasoning_content").isNotNull(),
        finish.eqNullSafe(F.lit("length")),
        ~finish.eqNullSafe(F.lit("stop")),
        ~F.col("content").rlike(r"\S"),
        F.col("content").rlike(K.THINK_TAG_PATTERN),
        F.col("doc").isNull(),
        ~F.col("valid_shape"),
        *narrative_checks(narratives),
        F.size(F.array_distinct("texts")) < F.size("texts"),
        F.size(F.array_except(F.flatten("evidence"), F.col("available"))) > 0,
    ]
    verdict = F.coalesce(
        *[
            F.when(condition, F.struct(F.lit(reason).alias("reason"), F.lit(field).alias("field_path")))
            for condition, (reason, field) in zip(conditions, REASONS)
        ]
    )
    return rows.withColumn("verdict", verdict).select(
        *briefs.columns, F.col("verdict.reason").alias("reason"), F.col("verdict.field_path").alias("field_path")
    )


def rejections(checked: DataFrame) -> DataFrame:
    """One record per rejected brief, with a digest in place of the text."""
    finish = F.col("finish_reason")
    return checked.filter(F.col("reason").isNotNull()).select(
        "brief_id",
        "reason",
        "field_path",
        F.when(finish.isin(*K.BRIEF_FINISH_REASONS), finish).otherwise(F.lit("unknown")).alias("finish_reason"),
        "prompt_tokens",
        "completion_tokens",
        F.sha2(F.col("content"), 256).alias("output_sha256"),
    )


def reply_valid(content: Column) -> Column:
    """Whether a reply is exactly ``{"status": "ok", "summary": <1..300 characters>}``."""
    doc = parsed_json(content)
    fields = F.try_variant_get(doc, "$", "map<string,variant>")
    status, summary = (F.try_element_at(fields, F.lit(k)) for k in ("status", "summary"))
    rules = [
        ~F.lower(content).rlike("</?think>"),
        _closed(F.map_keys(fields), ("status", "summary")),
        F.coalesce(F.schema_of_variant(status) == "STRING", F.lit(False)),
        F.coalesce(F.try_variant_get(status, "$", "string") == "ok", F.lit(False)),
        F.coalesce(F.schema_of_variant(summary) == "STRING", F.lit(False)),
        _between(F.length(F.try_variant_get(summary, "$", "string")), (1, 300)),
    ]
    return F.coalesce(reduce(lambda a, b: a & b, rules), F.lit(False))
