"""Settings of a recogniser by the name of its decode profile, and checks of a run's arguments; no Spark is needed."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

#: The profiles, those that neither penalise nor ban repetition beyond a run of 32, and their guards.
PROFILES = (
    "legacy", "native", "faithful", "grounded-faithful", "coverage-audit-faithful", "grounded-coverage-audit-faithful", "coverage-gated-faithful",
    "grounded-coverage-faithful", "faithful-beam2", "par-pp", "par-full", "spin-visual",
)
UNFAITHFUL = {"legacy": 8, "native": 0}
GUARDS = {
    "grounded-faithful": "visual_grounding_plus_repetitive_xml_tail",
    "grounded-coverage-audit-faithful": "visual_grounding_plus_semantic_visual_close_gate",
    "grounded-coverage-faithful": "visual_grounding_plus_semantic_visual_close_gate",
    "coverage-audit-faithful": "audit_semantic_body_close_with_visual_lines",
    "coverage-gated-faithful": "gate_semantic_body_close_with_visual_lines",
}
BEAMS = {"num_beams": 2, "num_return_sequences": 1, "early_stopping": False, "length_penalty": 1.0}
#: Profiles whose first attempts may be made two at a time.
PAIRED = ("legacy", "native", "faithful", "grounded-faithful")
AUDIT_ONLY = ("response_only_repetition_penalty", "targeted_loop_guard")


def generation_settings(profile: str) -> dict[str, object]:
    """The settings of a profile, audit entries included; an error for an unknown name."""
    if profile not in PROFILES:
        raise ValueError(f"unknown decode profile {profile!r}")
    faithful = profile not in UNFAITHFUL
    out: dict[str, object] = {"do_sample": False, "use_cache": True, "repetition_penalty": 1.0 if faithful else 1.05}
    out["no_repeat_ngram_size"] = 32 if faithful else UNFAITHFUL[profile]
    out["response_only_repetition_penalty"] = 1.01 if faithful else None
    out["targeted_loop_guard"] = GUARDS.get(profile, "no_repeat_ngram_size_32" if faithful else None)
    return out | (BEAMS if profile.endswith("-beam2") else {})


def model_settings(profile: str) -> dict[str, object]:
    """What a model is given: the settings without the audit entries."""
    return {k: v for k, v in generation_settings(profile).items() if k not in AUDIT_ONLY}


def _refuse(rules: list[tuple[bool, str]]) -> None:
    wrong = [text for broken, text in rules if broken]
    if wrong:
        raise ValueError("; ".join(wrong))


@dataclass(frozen=True)
class GateArguments:
    """Numbers of the close gate; values out of range are an error."""

    penalty: float = 2.5
    most_penalty: float = 6.0
    most_margin: float = 4.0
    continue_margin: float = 0.25
    anchor_similarity: float = 0.70
    view_consensus: float = 0.82
    remaining_lines: int = 2
    most_interventions: int = 2

    def __post_init__(self) -> None:
        numbers = (self.penalty, self.most_penalty, self.most_margin, self.continue_margin, self.anchor_similarity, self.view_consensus)
        _refuse(
            [
                (not all(map(isfinite, numbers)), "the gate's numbers must be finite"),
                (not 0 <= self.penalty <= self.most_penalty, "penalties must rise from 0"),
                (min(self.most_margin, self.continue_margin) < 0, "margins must not be negative"),
                (self.most_penalty < self.most_margin + self.continue_margin, "most_penalty must cover both margins"),
                (not 0 <= self.anchor_similarity <= 1, "anchor_similarity must be in [0, 1]"),
                (not 0 <= self.view_consensus <= 1, "view_consensus must be in [0, 1]"),
                (min(self.remaining_lines, self.most_interventions) < 1, "counts must be positive"),
            ]
        )


@dataclass(frozen=True)
class RunArguments:
    """Arguments of a recognition run; contradictory ones are an error."""

    profile: str = "legacy"
    adapter: str | None = None
    adapter_label: str | None = None
    batch_size: int = 1
    scaled: bool = False
    continuous_budget: bool = False
    selective_retry: bool = False
    line_evidence: str | None = None
    verifier_evidence: str | None = None
    require_verifier: bool = False
    require_page_evidence: bool = False
    gate: GateArguments = GateArguments()

    def __post_init__(self) -> None:
        generation_settings(self.profile)
        covers, several = "coverage" in self.profile, self.batch_size > 1
        _refuse(
            [
                (bool(self.adapter_label) and not self.adapter, "adapter_label needs adapter"),
                (self.batch_size not in (1, 2), "batch_size must be 1 or 2"),
                (several and self.profile not in PAIRED, "this profile takes one page at a time"),
                (several and self.scaled, "scaled layers or heads take one page at a time"),
                (several and self.continuous_budget, "a continuous budget takes one page at a time"),
                (self.selective_retry and not self.continuous_budget, "selective_retry needs continuous_budget"),
                (self.scaled and not self.adapter, "scaling needs adapter"),
                (covers and not self.line_evidence, "a coverage profile needs line_evidence"),
                (self.require_verifier and not self.verifier_evidence, "require_verifier needs verifier_evidence"),
                (self.require_page_evidence and not covers, "require_page_evidence needs a coverage profile"),
            ]
        )


@dataclass(frozen=True)
class LoopStopArguments:
    """Parameters of a loop stop; values that would stop good text, or never look, are an error."""

    repeats: int = 3
    block_lines: int = 4
    check_every: int = 16
    tail_tokens: int = 1024

    def __post_init__(self) -> None:
        _refuse(
            [
                (self.repeats < 3 or self.block_lines < 1, "too little counts as a loop"),
                (self.check_every < 1 or self.tail_tokens < 128, "check_every or tail_tokens is too small"),
            ]
        )
