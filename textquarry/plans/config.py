"""Settings of a run: defaults, then what is asked for, then what the dataset's manifest says."""

from __future__ import annotations

import dataclasses

from pyspark.sql import SparkSession

from textquarry.functions import fixed, maths
from textquarry.operators.subwords import Vocabulary


@dataclasses.dataclass
class RunConfig:
    # The defaults of a run.
    seed: int = fixed.SPLIT_SEED
    vocabulary_size: int = fixed.VOCABULARY
    context_length: int = 1024
    batch_size: int = 8
    accumulation_steps: int = 4
    learning_rate: float = 3e-4
    min_learning_rate: float = 3e-5
    warmup_steps: int = 0
    warmup_fraction: float = 0.1
    epochs: float | None = 5.0
    steps: int = 0
    vocab_size: int = 0
    tokenizer_sha256: str = ""
    dtype: str = "uint16"

    @classmethod
    def from_dict(cls, values: dict) -> RunConfig:
        """Unknown keys are left out."""
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})


def check_vocabulary(vocabulary: Vocabulary, vocab_size: int, sha256: str) -> None:
    """A vocabulary that isn't the one a manifest or a checkpoint names is refused."""
    for what, found, want in (("vocab_size", len(vocabulary), vocab_size), ("sha256", vocabulary.sha256(), sha256)):
        if found != want:
            raise ValueError(f"tokenizer mismatch in {what}: {found!r}, expected is {want!r}")


def resolved(spark: SparkSession, manifest: dict, vocabulary: Vocabulary, **asked) -> tuple[RunConfig, dict]:
    """(settings, budget): either epochs or steps may be asked for, and the vocabulary must be the manifest's."""
    epochs, steps = asked.pop("epochs", None), asked.pop("steps", None)
    if epochs is not None and steps is not None:
        raise ValueError("ask for either epochs or steps")
    if (epochs is not None and epochs <= 0) or (steps is not None and steps <= 0):
        raise ValueError("epochs and steps must be positive")
    unknown = set(asked) - {f.name for f in dataclasses.fields(RunConfig)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = RunConfig(**{k: v for k, v in asked.items() if v is not None})
    if steps is not None:
        out.epochs, out.steps = None, steps
    elif epochs is not None:
        out.epochs = epochs
    said = manifest["tokenizer"]
    check_vocabulary(vocabulary, said["vocab_size"], said["sha256"])
    out.vocab_size, out.tokenizer_sha256, out.dtype = len(vocabulary), said["sha256"], manifest["preprocessing"]["dtype"]
    counts = {s: manifest["splits"][s]["token_count"] for s in fixed.SPLITS}
    plan = maths.budget(
        spark, counts["train"], epochs=out.epochs, steps=out.steps, batch=out.batch_size, accumulation=out.accumulation_steps, context=out.context_length, warmup=out.warmup_steps,
        warmup_fraction=out.warmup_fraction, validation_tokens=counts["validation"], test_tokens=counts["test"],
    ).first()
    return out, plan.asDict()
