"""Comparison of paired facts field by field, settlement by code, and the rules a model's verdict has to meet.

A pair row has both sides as structs ``source`` and ``target`` with ``id, subject, predicate, raw_value, canonical_value,
canonical_number, unit, qualifiers, modality, attributed_to, period``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factengine.functions.text import affinity, filled, same_text
from factengine.operators.bandjoin import TOLERANCE
from factengine.operators.gates import key_pattern, qualifier_entries
from factengine.operators.providers import ADJUDICATION_SYSTEM, REVIEW_SYSTEM, AdjudicationProvider, InsufficientByDefault, SchemaFailure, delimited, with_retry
from factengine.schemas import FIELDS, REASON, VERDICT

# Below this share of the larger value a difference is not decided; fields that must match before a
# contradiction stands; what a blocked contradiction is called; reasons that have a direction.
UNDECIDED = 0.005
DECISIVE = ("time", "scope", "unit", "modality", "attribution")
BLOCKED = {"unit": "unit_mismatch", "scope": "scope_mismatch", "modality": "projection_vs_actual", "attribution": "attribution_mismatch"}
DIRECTIONAL = ("time_supersession", "vintage_difference", "projection_vs_actual")
MATCHED, MISMATCHED, UNKNOWN = "matched", "mismatched", "unknown"


def _state(matched: Column, unknown: Column | None = None) -> Column:
    known = F.when(F.coalesce(matched, F.lit(False)), MATCHED).otherwise(MISMATCHED)
    return known if unknown is None else F.when(F.coalesce(unknown, F.lit(True)), UNKNOWN).otherwise(known)


def compare_time(a: Column, b: Column) -> Column:
    """Equal bounds match; overlapping but unequal periods do not, and precision does not matter."""
    return _state((a["start"] == b["start"]) & (a["end"] == b["end"]), a.isNull() | b.isNull())


def periods_overlap(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def scope_of(qualifiers: Column) -> Column:
    """Qualifiers that are about scope: not about time, not empty; lower case. The last of equal keys counts."""
    kept = F.filter(qualifier_entries(qualifiers), lambda e: ~e["key"].rlike(key_pattern("period")) & (e["key"] != "as_of") & (F.length(e["value"]) > 0))
    lower = F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.lower(e["value"]).alias("value")))
    last = F.filter(lower, lambda e, i: ~F.exists(F.slice(lower, i + 2, F.greatest(F.size(lower), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def compare_scope(a: Column, b: Column) -> Column:
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    none = (F.size(a) == 0) & (F.size(b) == 0)
    agree = F.forall(shared, lambda k: F.try_element_at(a, k) == F.try_element_at(b, k))
    return F.when(none, MATCHED).when(F.size(shared) == 0, UNKNOWN).otherwise(_state(agree))


def compare_unit(a: Column, b: Column) -> Column:
    return F.when(~filled(a) & ~filled(b), MATCHED).when(~filled(a) | ~filled(b), UNKNOWN).otherwise(_state(same_text(a, b)))


def compare_attribution(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), MATCHED).when(a.isNull() | b.isNull(), MISMATCHED).otherwise(_state(same_text(a, b)))


def relative_delta(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def compare_value(a_text: Column, a_number: Column, b_text: Column, b_number: Column) -> Column:
    delta = relative_delta(a_number, b_number)
    numbers = F.when(delta <= TOLERANCE, MATCHED).when(delta <= UNDECIDED, UNKNOWN).otherwise(MISMATCHED)
    return F.when(a_number.isNotNull() & b_number.isNotNull(), numbers).when(a_text.isNotNull() & b_text.isNotNull(), _state(a_text == b_text)).otherwise(UNKNOWN)


def compare_text(a: Column, b: Column) -> Column:
    return _state(affinity(a, b) >= 0.5)


def compare(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``comparison`` (a state per field), ``matched, mismatched, unknown`` (fields in a fixed order),
    ``delta, same_sign, overlap, values_equal`` and ``settled``, the reason code if code alone can settle the pair."""
    s, t = F.col("source"), F.col("target")
    scoped = pairs.withColumn("__a", scope_of(s["qualifiers"])).withColumn("__b", scope_of(t["qualifiers"]))
    states = {
        "subject": compare_text(s["subject"], t["subject"]),
        "predicate": compare_text(s["predicate"], t["predicate"]),
        "time": compare_time(s["period"], t["period"]),
        "scope": compare_scope(F.col("__a"), F.col("__b")),
        "unit": compare_unit(s["unit"], t["unit"]),
        "value": compare_value(s["canonical_value"], s["canonical_number"], t["canonical_value"], t["canonical_number"]),
        "modality": _state(s["modality"] == t["modality"]),
        "attribution": compare_attribution(s["attributed_to"], t["attributed_to"]),
    }
    out = scoped.withColumn("comparison", F.struct(*(states[f].alias(f) for f in FIELDS))).drop("__a", "__b")
    of = lambda state: F.array_compact(F.array(*(F.when(F.col(f"comparison.{f}") == state, F.lit(f)) for f in FIELDS)))
    numbers = s["canonical_number"].isNotNull() & t["canonical_number"].isNotNull()
    out = out.withColumns(
        {
            "matched": of(MATCHED),
            "mismatched": of(MISMATCHED),
            "unknown": of(UNKNOWN),
            "values_equal": F.col("comparison.value") == MATCHED,
            "delta": F.when(numbers, relative_delta(s["canonical_number"], t["canonical_number"])),
            "same_sign": F.when(numbers, F.signum(s["canonical_number"]) == F.signum(t["canonical_number"])),
            "overlap": periods_overlap(s["period"], t["period"]),
        }
    )
    decided = F.size(F.array_except(F.array(*map(F.lit, ("value", *DECISIVE))), "matched")) == 0
    about = (F.col("comparison.subject") != MISMATCHED) & (F.col("comparison.predicate") != MISMATCHED)
    return out.withColumn("settled", F.when(decided & about, F.when(same_text(s["raw_value"], t["raw_value"]), "exact_duplicate").otherwise("equivalent_value")))


def forms(pairs: DataFrame) -> DataFrame:
    """``(pair_key, n, source, target)``: pairs that agree in all but their ids, as one row for ``n`` of them.

    Comparison, rules and providers read no ids, so what holds of a form holds of its pairs, and a judge is asked once. A
    form's ids are null, so its edges have no direction; their numbers are what counts.
    """
    kinds = {p: pairs.schema[p].dataType for p in ("source", "target")}
    named = {f"__{p}_{f.name}": (p, f) for p in kinds for f in kinds[p].fields if f.name != "id"}
    is_map = lambda f: isinstance(f.dataType, T.MapType)
    told = pairs.select(*((F.map_entries(F.col(p)[f.name]) if is_map(f) else F.col(p)[f.name]).alias(c) for c, (p, f) in named.items()))
    rows = told.groupBy(*named).agg(F.count("*").alias("n"))
    back = lambda c, f: F.map_from_entries(c) if is_map(f) else F.col(c)
    side = lambda p: F.struct(F.lit(None).cast(kinds[p]["id"].dataType).alias("id"), *(back(c, f).alias(f.name) for c, (q, f) in named.items() if q == p))
    return rows.select(F.sha2(F.to_json(F.struct(*named)), 256).alias("pair_key"), "n", side("source").alias("source"), side("target").alias("target"))


def settled_explanation(reason: Column) -> Column:
    return F.when(reason == "exact_duplicate", "Both documents print the same value for the same claim.").otherwise("Both documents state the same value for the same claim in different words.")


def resolve_first_pass(judged: DataFrame) -> DataFrame:
    """Applies the rules to a model's reply in ``reply`` (``verdict, reasonCode, contextMatches, explanation, confidence``):
    adds ``verdict, reason_code, matched_fields, mismatched_fields, explanation, confidence, withheld``.

    A reply may speak only for fields that code could not compare. A contradiction stands if the values differ and every
    decisive field matches; then its reason is ``value_conflict``. Else the first field in the way names the reason.
    """
    r = F.col("reply")
    out = judged.withColumn("matched_fields", F.concat("matched", F.array_intersect("unknown", F.coalesce(r["contextMatches"], F.array().cast("array<string>")))))
    claims = r["verdict"] == "contradicts"
    differs = F.array_contains("mismatched", "value")
    blocker = F.get(F.array_except(F.array(*map(F.lit, DECISIVE)), "matched_fields"), F.lit(0))
    named = F.coalesce(*(F.when(blocker == f, F.lit(code)) for f, code in BLOCKED.items()), F.lit("missing_context"))
    blocked_differs = F.array_contains("mismatched", blocker)
    withheld = claims & (~differs | blocker.isNotNull())
    why = F.when(~differs, "nothing shows that the values differ").otherwise(F.concat(blocker, F.when(blocked_differs, " is not the same on both sides").otherwise(" is unknown on one side at least")))
    return out.withColumns(
        {
            "verdict": F.when(withheld, "insufficient").otherwise(r["verdict"]),
            "reason_code": F.when(withheld & differs & blocked_differs, named).when(withheld, "missing_context").when(claims, "value_conflict").otherwise(r["reasonCode"]),
            "mismatched_fields": F.col("mismatched"),
            "explanation": F.when(withheld, F.concat(F.lit("Withheld a contradiction: "), why, F.lit(". "), r["explanation"])).otherwise(r["explanation"]),
            "confidence": r["confidence"],
            "withheld": F.coalesce(withheld, F.lit(False)),
        }
    )


def orient(edges: DataFrame) -> DataFrame:
    """Adds ``source_id, target_id``: for reasons with a direction the side that wins comes first, the observation before
    the projection or the later period; all others, and ties, go by id."""
    s, t, code = F.col("source"), F.col("target"), F.col("reason_code")
    by_id = s["id"] < t["id"]
    end_s, end_t = (F.coalesce(x["period"]["end"].cast("string"), F.lit("")) for x in (s, t))
    by_modality = F.when(s["modality"].eqNullSafe(t["modality"]), by_id).otherwise(F.coalesce(s["modality"] == "observed", F.lit(False)))
    by_time = F.when(end_s == end_t, by_id).otherwise(end_s > end_t)
    keep = F.when(code == "projection_vs_actual", by_modality).when(code.isin(*DIRECTIONAL), by_time).otherwise(by_id)
    return edges.withColumn("source_id", F.when(keep, s["id"]).otherwise(t["id"])).withColumn("target_id", F.when(keep, t["id"]).otherwise(s["id"]))


def split_unknown(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose sides are both there, and skip rows ``(pair_key, reason, detail)`` that name the missing ids."""
    missing = F.col("source.id").isNull() | F.col("target.id").isNull()
    names = F.concat_ws(", ", F.when(F.col("source.id").isNull(), F.col("source_id")), F.when(F.col("target.id").isNull(), F.col("target_id")))
    skips = pairs.where(missing).select("pair_key", F.lit("unknown_assertion").alias("reason"), F.concat(F.lit("not among the published facts: "), names).alias("detail"))
    return pairs.where(~missing), skips


_REPLY = "verdict string, reasonCode string, contextMatches array<string>, explanation string, confidence double"
_REVIEW = "reconcilable boolean, reasonCode string, explanation string, confidence double"


def check_reply(reply: object, review: bool) -> dict:
    """A reply of the right shape, or :class:`SchemaFailure`."""
    if not isinstance(reply, dict) or reply.get("reasonCode") not in REASON or not isinstance(reply.get("explanation"), str):
        raise SchemaFailure("a reply needs a known reason code and an explanation")
    if review and not isinstance(reply.get("reconcilable"), bool) or not review and (reply.get("verdict") not in VERDICT or not set(reply.get("contextMatches") or []) <= set(FIELDS)):
        raise SchemaFailure("a reply lacks its verdict or names unknown fields")
    confidence = reply.get("confidence")
    if confidence is not None and not 0 <= confidence <= 1:
        raise SchemaFailure("confidence is between 0 and 1")
    return reply


_ANSWER = T.StructType([T.StructField(n, T.StringType()) for n in ("reply", "skip_reason", "skip_detail")])


def ask(payload: Column, provider: AdjudicationProvider, review: bool = False) -> Column:
    """``struct<reply, skip_reason, skip_detail>``, the reply as JSON: one call per payload, tried once more unless the failure
    is permanent; null payloads are not asked."""
    name, system = ("contradiction_review", REVIEW_SYSTEM) if review else ("pair_adjudication", ADJUDICATION_SYSTEM)
    fields = [f.split()[0] for f in (_REVIEW if review else _REPLY).split(", ")]

    def one(text: str | None) -> tuple[str | None, str | None, str | None]:
        if text is None:
            return None, None, None
        extra = {"escalate": True} if review else {}
        try:
            reply = with_retry(lambda: check_reply(provider.generate(name=name, system=system, prompt=delimited(json.loads(text)), schema={"fields": fields}, **extra), review))
            return json.dumps({f: reply.get(f) for f in fields}), None, None
        except SchemaFailure as failure:
            return None, "invalid_output", str(failure)
        except Exception as failure:
            return None, "model_error", str(failure)

    @F.pandas_udf(_ANSWER)
    def run(payloads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in payloads], columns=_ANSWER.names, dtype=object)

    return run.asNondeterministic()(payload)


#: What a judge sees of each side.
SHOWN = ("document_id", "page", "subject", "predicate", "raw_value", "canonical_value", "unit", "value_type", "period", "qualifiers", "modality", "attributed_to", "table_context", "quote")


def payload(pairs: DataFrame, first_reading: Column | None = None) -> Column:
    """What a judge sees of a pair, as JSON: fourteen fields of each side, null where the pairs have no such field, what code
    has found, and for a review the explanation of the first reading."""

    def side(name: str) -> Column:
        there = pairs.schema[name].dataType.names
        return F.struct(*((F.col(f"{name}.{c}") if c in there else F.lit(None).cast("string")).alias(c) for c in SHOWN)).alias(name)

    findings = F.struct("matched", "mismatched", "unknown", "values_equal", "same_sign", "delta", "overlap").alias("findings")
    reading = [] if first_reading is None else [first_reading.alias("first_reading")]
    return F.to_json(F.struct(side("source"), side("target"), findings, *reading), {"ignoreNullFields": "false"})


def adjudicate(pairs: DataFrame, pipeline_version: str, provider: AdjudicationProvider | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and skips of hydrated pairs, both from one pass over the pairs without a shuffle.

    Code settles what it can; only the rest is put to the provider, and only contradictions that survive the rules to its
    second pass, which is told the first reading. Persist or write the edges before the skips are read as well, or the provider is asked again; providers
    must be pure functions of the pair.
    """
    provider = provider or InsufficientByDefault()
    c, none = F.col, F.lit(None).cast("string")
    found = compare(pairs)
    open_pair = c("settled").isNull()
    asked = found.withColumn("__first", ask(F.when(open_pair, payload(found)), provider))
    first = resolve_first_pass(asked.withColumn("reply", F.from_json("__first.reply", _REPLY)))
    contested = open_pair & F.coalesce(c("verdict") == "contradicts", F.lit(False))
    reviewed = first.withColumn("reviewed", contested).withColumn("__second", ask(F.when(contested, payload(first, c("explanation"))), provider, review=True))
    judged = reviewed.withColumn("__review", F.from_json("__second.reply", _REVIEW))
    r = c("__review")
    yes = F.coalesce(r["reconcilable"], F.lit(False))
    kept = F.concat("explanation", F.lit(" A second reading with the burden reversed found nothing that reconciles them: "), r["explanation"])
    final = judged.select(
        "pair_key",
        *(["n"] if "n" in pairs.columns else []),
        "source",
        "target",
        "settled",
        F.when(~open_pair, "corroborates").when(yes, "reconciles").otherwise(c("verdict")).alias("verdict"),
        F.when(~open_pair, c("settled")).when(yes, r["reasonCode"]).otherwise(c("reason_code")).alias("reason_code"),
        F.when(~open_pair, c("matched")).otherwise(c("matched_fields")).alias("matched_fields"),
        c("mismatched").alias("mismatched_fields"),
        F.when(~open_pair, settled_explanation(c("settled"))).when(yes, r["explanation"]).when(c("reviewed"), kept).otherwise(c("explanation")).alias("explanation"),
        F.when(~open_pair, 1.0).when(yes, r["confidence"]).otherwise(c("confidence")).alias("confidence"),
        "withheld",
        "reviewed",
        yes.alias("downgraded"),
        F.when(yes, c("verdict")).otherwise(none).alias("prior_verdict"),
        F.when(yes, c("explanation")).otherwise(none).alias("prior_explanation"),
        F.coalesce("__first.skip_reason", "__second.skip_reason").alias("__skip"),
        F.coalesce("__first.skip_detail", "__second.skip_detail").alias("__detail"),
    )
    skips = final.where("__skip is not null").select("pair_key", c("__skip").alias("reason"), c("__detail").alias("detail"))
    edges = orient(final.where("__skip is null")).withColumn("id", F.sha2(F.concat_ws("|", F.lit(pipeline_version), "source_id", "target_id"), 256)).withColumn("pipeline_version", F.lit(pipeline_version))
    return edges.drop("source", "target", "__skip", "__detail"), skips


def batch_stats(edges: DataFrame, skips: DataFrame) -> DataFrame:
    """One row of counters; judged edges are those that code did not settle."""
    verdicts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICT]
    flags = [F.count_if(F.col(c)).alias(c) for c in ("reviewed", "downgraded", "withheld")]
    counts = edges.agg(F.count("*").alias("edges"), F.count("settled").alias("settled"), F.count_if(F.col("settled").isNull()).alias("judged"), *verdicts, *flags)
    return counts.crossJoin(skips.agg(F.count("*").alias("skipped")))  # single rows


