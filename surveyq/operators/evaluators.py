"""Evaluators by name: what each needs, and the DataFrame it makes of the tables it is given."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from surveyq.functions import scores as S
from surveyq.functions import vector as V
from surveyq.operators import citations, evidence, models, pairs, scoring, summary

Evaluator = Callable[[Mapping[str, DataFrame], Mapping[str, object]], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Evaluator
    tables: tuple[str, ...]
    settings: tuple[str, ...] = ()


REGISTRY: dict[str, Entry] = {
    "citation": Entry(lambda t, c: citations.citation_metrics(t["surveys"], citations.match_references(t["refs"], citations.title_index(t["corpus"])), t["truth"]), ("surveys", "refs", "corpus", "truth")),
    "diversity": Entry(lambda t, c: V.diversity(t["embeddings"], [str(c["by"])]), ("embeddings",), ("by",)),
    "repetition": Entry(
        lambda t, c: pairs.repetition_share(pairs.similar_pairs(t["sentences"], "survey_key", "sentence_id", None, at_least=float(c["threshold"])), t["sentences"], "survey_key"),
        ("sentences",), ("threshold",),
    ),
    "expert": Entry(lambda t, c: scoring.expert_profile(t["claims"], [str(c["by"])]), ("claims",), ("by",)),
    "alignment": Entry(
        lambda t, c: scoring.citation_correctness(t["claims"].join(models.align_cascade(t["pairs"], c["aligner"], c["embedder"], list(c["keys"])), list(c["keys"]), "left"), list(c["by"])),
        ("claims", "pairs"), ("aligner", "embedder", "keys", "by"),
    ),
    "contradiction": Entry(lambda t, c: models.contradictions(t["pairs"], c["topic"], c["check"], list(c["by"])), ("pairs",), ("topic", "check", "by")),
    "evidence": Entry(lambda t, c: evidence.coverage(t["evidence"], list(c["by"])), ("evidence",), ("by",)),
    "expert_validation": Entry(lambda t, c: S.class_scores(t["judged"], "gold", "predicted", list(c["classes"])), ("judged",), ("classes",)),
    "rouge": Entry(lambda t, c: models.rouge_n(t["texts"], list(c["keys"]), "candidate", "reference", int(c["n"])), ("texts",), ("keys", "n")),
    "bleu": Entry(lambda t, c: models.bleu(t["texts"], list(c["keys"]), "candidate", "reference"), ("texts",), ("keys",)),
    "summary": Entry(lambda t, c: summary.metric_summary(t["long"], list(c["by"])), ("long",), ("by",)),
}


def register(name: str, build: Evaluator, tables: tuple[str, ...], settings: tuple[str, ...] = ()) -> None:
    """Add an evaluator; a name that is taken is an error."""
    if name in REGISTRY:
        raise ValueError(f"{name} is registered already")
    REGISTRY[name] = Entry(build, tables, settings)


def load_evaluator(name: str, config: Mapping[str, object]) -> Callable[[Mapping[str, DataFrame]], DataFrame]:
    """The evaluator of this name with its settings; unknown names and missing settings are errors, missing tables one when it is called."""
    if name not in REGISTRY:
        raise ValueError(f"no evaluator {name}; there are {', '.join(sorted(REGISTRY))}")
    entry = REGISTRY[name]
    if lacking := [s for s in entry.settings if s not in config]:
        raise ValueError(f"evaluator {name} needs the settings {', '.join(lacking)}")

    def evaluate(tables: Mapping[str, DataFrame]) -> DataFrame:
        if lacking := [t for t in entry.tables if t not in tables]:
            raise ValueError(f"evaluator {name} needs the tables {', '.join(lacking)}")
        return entry.build(tables, config)

    return evaluate
