"""Profiles: what happens to a span, by label and risk."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import patterns
from umbra.functions.text import generalize

RISKS = {"low": 1, "medium": 2, "high": 3, "critical": 4}
# Labels that stay in clear as facts, and the seven semantic labels.
_FACTS = ("AMOUNT", "DATE", "COURT", "ARBITRATION", "STATUTE")
_OPINIONS = ("INTERNAL_OPINION", "LEGAL_STRATEGY", "RISK_JUDGMENT", "NEGOTIATION_FLOOR", "NEGOTIATION_STRATEGY", "NEGOTIATION_POSITION", "INTERNAL_PROCESS")


@dataclass(frozen=True)
class Profile:
    name: str
    scope: str = "document"
    deny: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    generalize: dict[str, str] = field(default_factory=dict)
    actions: dict[str, str] = field(default_factory=dict)
    min_risk: str = "low"
    roles: str | None = None
    strict_refill: bool = True
    block_min_severity: str | None = None
    model_required: bool = False
    use_model: bool = True
    block_unknown_placeholders: bool = False
    alert_min_severity: str = "warn"

    def __post_init__(self) -> None:
        if self.scope not in ("document", "session", "namespace"):
            raise ValueError(f"unknown scope {self.scope}")
        if self.roles not in (None, "contract", "investment"):
            raise ValueError(f"unknown role set {self.roles}")

    @property
    def reversible(self) -> bool:
        return not self.generalize and "generalize" not in self.actions.values()


# The presets, sensitivity tiers and scenarios.
PROFILES = {
    p.name: p
    for p in (
        Profile("kb", "session", strict_refill=False, use_model=False),
        Profile("contract_review", deny=_FACTS, model_required=True),
        Profile("agent", "session", strict_refill=False),
        Profile("strict", model_required=True),
        Profile("file_workbench"),
        Profile("review", actions=dict.fromkeys(_OPINIONS, "warn"), model_required=True),
        Profile("light", only=("CONTACT", "BANK_ACCOUNT", "CREDENTIAL", "ORG_CODE", "SYSTEM_URL"), use_model=False),
        Profile("standard", deny=_FACTS, actions=dict.fromkeys(_OPINIONS, "pass")),
        Profile("ultra", actions={"CREDENTIAL": "block"}, block_min_severity="critical", model_required=True),
        Profile("contract", deny=_FACTS, generalize={"ADDRESS": "region"}, actions=dict.fromkeys(("LEGAL_STRATEGY", "NEGOTIATION_POSITION"), "block"), roles="contract", model_required=True),
        Profile("pre_investment", generalize={"AMOUNT": "amount_band_10yi"}, actions=dict.fromkeys(("LEGAL_STRATEGY", "NEGOTIATION_POSITION"), "block"), model_required=True),
        Profile("litigation", deny=_FACTS, generalize={"ADDRESS": "region"}, actions=dict.fromkeys(("COURT", "ARBITRATION", "STATUTE"), "pass"), model_required=True),
    )
}


def resolve(base: str = "strict", **overrides) -> Profile:
    return replace(PROFILES[base], **overrides)


def declared(app: dict) -> Profile:
    """The profile of an application's declaration: `profile` goes before `scenario`, that before `sensitivity`, and nothing means strict.

    A name is looked up among presets, tiers and scenarios, which share no name; a dict has `base` and overrides.
    """
    named = next((app[k] for k in ("profile", "scenario", "sensitivity") if app.get(k)), "strict")
    if isinstance(named, dict):
        return resolve(named.get("base", "strict"), **{k: v for k, v in named.items() if k != "base"})
    if named not in PROFILES:
        raise ValueError(f"unknown profile {named}")
    return PROFILES[named]


def check_declared_labels(profile: Profile, labels: tuple[str, ...]) -> None:
    """Labels whose values an application may declare must be replaced or blocked by its profile, else they would be declared in vain."""
    for label in labels:
        if label in profile.deny or (profile.only and label not in profile.only and label not in profile.actions) or profile.actions.get(label) in ("pass", "warn") or label in profile.generalize:
            raise ValueError(f"profile {profile.name} leaves declared label {label} in clear")


def dimensions(profile: Profile) -> dict:
    """The profile as five parts: detection, scenario, mapping, refill, guard."""
    return {
        "name": profile.name,
        "detection": {"use_model": profile.use_model, "model_required": profile.model_required, "rules_required": True, "dictionary_required": True},
        "scenario": {"only": list(profile.only), "deny": list(profile.deny), "min_risk": profile.min_risk, "actions": dict(profile.actions), "generalize": dict(profile.generalize), "roles": profile.roles},
        "mapping": {"mode": profile.scope},
        "refill": {"strict": profile.strict_refill},
        "guard": {"block_unknown_placeholders": profile.block_unknown_placeholders, "alert_min_severity": profile.alert_min_severity, "block_min_severity": profile.block_min_severity},
    }


def from_dimensions(parts: dict) -> Profile:
    """The way back. What a profile can't express is turned away: optional rules or dictionary, and mapping by namespace."""
    if not (parts["detection"]["rules_required"] and parts["detection"]["dictionary_required"]):
        raise ValueError("a profile always requires rules and a dictionary")
    if parts["mapping"]["mode"] == "namespace":
        raise ValueError("a profile can't express mapping by namespace")
    scenario = parts["scenario"]
    return Profile(
        parts["name"], parts["mapping"]["mode"], tuple(scenario["deny"]), tuple(scenario["only"]), dict(scenario["generalize"]), dict(scenario["actions"]), scenario["min_risk"], scenario["roles"], parts["refill"]["strict"],
        parts["guard"]["block_min_severity"], parts["detection"]["model_required"], parts["detection"]["use_model"], parts["guard"]["block_unknown_placeholders"], parts["guard"]["alert_min_severity"],
    )


def version(profile: Profile) -> str:
    """A hash of the profile's parts, by which receipts name it."""
    return "sha256:" + hashlib.sha256(json.dumps(dimensions(profile), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def profile_table(spark: SparkSession) -> DataFrame:
    """A row for each profile: name, scope, use_model, model_required, strict_refill, reversible, block_min_severity."""
    rows = [(p.name, p.scope, p.use_model, p.model_required, p.strict_refill, p.reversible, p.block_min_severity) for p in PROFILES.values()]
    return spark.createDataFrame(rows, "name string, scope string, use_model boolean, model_required boolean, strict_refill boolean, reversible boolean, block_min_severity string")


def readiness(apps: DataFrame) -> DataFrame:
    """apps (profile, has_dictionary, model_loadable) with status: whether a job may start under the profile, before any text is read."""
    table = F.broadcast(profile_table(apps.sparkSession).select(F.col("name").alias("profile"), "use_model", "model_required"))  # a row a profile
    status = F.when(F.col("use_model").isNull(), "unknown_profile").when(~F.col("has_dictionary"), "dictionary_missing").when(F.col("model_required") & ~F.col("model_loadable"), "not_ready").when(F.col("use_model") & ~F.col("model_loadable"), "degraded").otherwise("ready")
    return apps.join(table, "profile", "left").withColumn("status", status).drop("use_model", "model_required")


def risk_rank(risk: Column | str) -> Column:
    """1 to 4; anything unknown counts as high."""
    r = F.col(risk) if isinstance(risk, str) else risk
    out = F.when(F.lit(False), 0)
    for name, rank in RISKS.items():
        out = out.when(r == name, rank)
    return out.otherwise(RISKS["high"])


def decide(profile: Profile, label: Column | str = "label", risk: Column | str = "risk_level", whole_key: Column | None = None) -> Column:
    """redact, generalize, pass, warn or block."""
    name = F.col(label) if isinstance(label, str) else label
    key = F.coalesce(whole_key, F.lit(False)) if whole_key is not None else F.lit(False)
    out = F.when(key, "block" if profile.actions.get("CREDENTIAL") == "block" else "redact")
    for action in sorted(set(profile.actions.values())):
        out = out.when(name.isin([k for k, v in profile.actions.items() if v == action]), action)
    if profile.generalize:
        out = out.when(name.isin(list(profile.generalize)), "generalize")
    if profile.deny:
        out = out.when(name.isin(list(profile.deny)), "pass")
    if profile.only:
        out = out.when(~name.isin(list(profile.only)), "pass")
    return out.when(risk_rank(risk) < RISKS[profile.min_risk], "pass").otherwise("redact")


def kept(profile: Profile, label: str, risk: str | None, whole_key: bool) -> bool:
    """Whether decide() gives redact, generalize or block, for code that has a span at hand."""
    if whole_key:
        return True
    if label in profile.actions:
        return profile.actions[label] in ("redact", "generalize", "block")
    if label in profile.generalize:
        return True
    in_clear = label in profile.deny or (profile.only and label not in profile.only)
    return not in_clear and RISKS.get(risk, RISKS["high"]) >= RISKS[profile.min_risk]


def _whole_key(spans: DataFrame) -> Column | None:
    """A whole private key is never left in clear, whatever labels a profile passes."""
    return F.col("rule_id") == patterns.PRIVATE_KEY.rule_id if "rule_id" in spans.columns else None


def coarse(profile: Profile, label: Column, surface: Column, action: Column) -> Column:
    """The value that stands in for a generalised one; null for others."""
    name = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, generalizer in profile.generalize.items():
        name = name.when(label == key, generalizer)
    return F.when(action == "generalize", generalize(name, surface)) if profile.generalize else F.lit(None).cast("string")


def apply(spans: DataFrame, profile: Profile) -> DataFrame:
    """spans with action and coarse (the value that stands in for a generalised one); passed and warned ones go."""
    out = spans.withColumn("action", decide(profile, whole_key=_whole_key(spans)))
    return out.withColumn("coarse", coarse(profile, F.col("label"), F.col("surface"), F.col("action"))).where(F.col("action").isin("redact", "generalize", "block"))


def blocked_labels(spans: DataFrame, profile: Profile) -> DataFrame:
    """doc_id, blocked: the labels of a document that its profile blocks, in order."""
    return spans.where(decide(profile, whole_key=_whole_key(spans)) == "block").groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("blocked"))


def applications(apps: DataFrame) -> DataFrame:
    """apps (profile, scenario, sensitivity, declared: labels whose values the application declares) with resolved, scope, reversible, min_rank, status.

    The first name that isn't null or empty counts, in this order; none means strict. status: unknown_profile; declared_in_clear
    (the profile would leave values of a declared label in clear, so they'd be declared in vain); else ok.
    """
    spark = apps.sparkSession
    labels = sorted({*_FACTS, *_OPINIONS, *(k for p in PROFILES.values() for k in (*p.only, *p.generalize, *p.actions))})
    rows = [(p.name, p.scope, p.reversible, RISKS[p.min_risk], [k for k in labels if _in_clear(p, k)], bool(p.only), [*p.only, *p.actions]) for p in PROFILES.values()]
    table = F.broadcast(spark.createDataFrame(rows, "resolved string, scope string, reversible boolean, min_rank int, in_clear array<string>, only boolean, kept array<string>"))  # a row a profile
    named = [F.when(F.trim(c) != "", F.trim(c)) for c in ("profile", "scenario", "sensitivity")]
    out = apps.withColumn("resolved", F.coalesce(*named, F.lit("strict"))).join(table, "resolved", "left")
    declared = F.coalesce("declared", F.array().cast("array<string>"))
    vain = F.arrays_overlap(declared, "in_clear") | (F.col("only") & (F.size(F.array_except(declared, "kept")) > 0))
    status = F.when(F.col("scope").isNull(), "unknown_profile").when(vain, "declared_in_clear").otherwise("ok")
    return out.withColumn("status", status).drop("in_clear", "only", "kept")


def _in_clear(profile: Profile, label: str) -> bool:
    try:
        check_declared_labels(profile, (label,))
    except ValueError:
        return True
    return False
