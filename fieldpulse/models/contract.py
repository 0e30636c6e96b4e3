"""Checks that models and features belong together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from fieldpulse.schemas import BASELINE_DAYS, FEATURES, HORIZON_DAYS, schema_version

SUPPORTED_MAJOR = "1"


class ContractError(ValueError):
    """A model was trained on something else than what is about to be scored."""


@dataclass(frozen=True)
class Manifest:
    """What a set of trained models promises."""

    threshold: float
    alert_rate: float
    feature_version: str = field(default_factory=schema_version)
    columns: tuple[str, ...] = tuple(FEATURES)
    horizon_days: int = HORIZON_DAYS
    baseline_days: int = BASELINE_DAYS
    schema_version: str = "1.0"

    def terms(self) -> dict[str, object]:
        """The entries that have to agree; of the contract's own version only the part before the first dot."""
        known = asdict(self) | {"schema_version": self.schema_version.partition(".")[0], "columns": tuple(self.columns)}
        return {name: value for name, value in known.items() if name not in ("threshold", "alert_rate")}


#: How the entries are called in messages.
TERMS = {"schema_version": "contract version", "horizon_days": "horizon in days", "baseline_days": "baseline days",
         "feature_version": "features", "columns": "feature columns (name or order)"}


def differences(trained: Manifest, here: Manifest) -> dict[str, tuple[object, object]]:
    """All entries in which two manifests differ, with both values."""
    offered = here.terms()
    return {TERMS[name]: (value, offered[name]) for name, value in trained.terms().items() if value != offered[name]}


def check_contract(manifest: Manifest, feature_version: str | None = None, columns: Sequence[str] | None = None) -> None:
    """Refuse a manifest that differs from what is served here, naming every difference at once."""
    here = Manifest(manifest.threshold, manifest.alert_rate, feature_version=feature_version or schema_version(),
                    columns=tuple(manifest.columns if columns is None else columns), schema_version=f"{SUPPORTED_MAJOR}.0")
    found = differences(manifest, here)
    if found:
        raise ContractError("; ".join(f"{name}: trained with {a!r}, here {b!r}" for name, (a, b) in found.items()))
