"""Charge-transparency analytics on Spark; the names that a user needs first, imported when they are asked for (Python workers import this package too)."""

from importlib import import_module

_NAMES = {
    "operators.compare": ["NotComparable", "build"], "operators.contracts": ["ContractViolation", "enforce", "evaluate"], "operators.findings": ["dimension_status", "grade", "matrix", "rollup"],
    "operators.normalize": ["LoadRefused", "WrongType", "by_content", "normalize", "require_loadable", "require_types"], "operators.rates": ["exploratory", "file_profile", "observations", "safe_median", "segmented_dollars"], "operators.sampling": ["seeded"],
    "operators.scorecard": ["NotComposed", "compose", "coverage", "dimensions", "file_rows", "grades", "require_composed"], "sources.charge_csv": ["ChargeCsv"], "sources.charge_json": ["ChargeJson"], "sources.registries": ["BadRecords", "assessments", "attempts"], "sources.snapshots": ["Changed", "snapshot"],
}
#: Public name to module and name there.
_PLACES = {n: (module, n) for module, names in _NAMES.items() for n in names} | {"inspect_csv": ("operators.inspect_csv", "inspect"), "inspect_json": ("operators.inspect_json", "inspect"), "counters": ("operators.inspect_json", "counters")}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, own = _PLACES[name]
    return getattr(import_module(f"{__name__}.{module}"), own)
