"""Settings: defaults, checks, and a project's own settings laid over them."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

# Default thresholds of the ratchet and of reports, history limits, scope globs and optional rules.
THRESHOLDS = {"cyclomaticComplexity": 10, "cognitiveComplexity": 17, "maxLinesPerFunction": 55, "maxFileLines": 330, "maxDepth": 3, "maxParams": 4, "maxNestedCallbacks": 3, "duplicationPercent": 3, "erosionFraction": 0.35, "verbosityFraction": 0.2}
REPORT_THRESHOLDS = {"cyclomaticComplexity": 25, "cognitiveComplexity": 30, "maxLinesPerFunction": 100, "maxFileLines": 600, "maxDepth": 5, "maxParams": 6}
REPORT_LEVEL_OF = {"cyclomatic-complexity": "cyclomaticComplexity", "cognitive-complexity": "cognitiveComplexity", "function-length": "maxLinesPerFunction", "file-length": "maxFileLines", "nesting-depth": "maxDepth", "too-many-params": "maxParams"}
CHURN = {"windowDays": 365, "maxFilesPerCommit": 20, "minCoChangeCommits": 5, "minCoChangeDegree": 0.5, "minHistoryCommits": 50}
KNIP = {"maxUnusedFileFraction": 0.33, "minUnusedFiles": 10}
OPTIONAL_RULES = ["assign-then-return", "boolean-ternary", "nested-callbacks", "passthrough-wrapper", "redundant-else", "superfluous-export", "unused-type"]
INCLUDE = ["**/*.ts", "**/*.tsx", "**/*.mts", "**/*.cts"]
EXCLUDE = ["node_modules/**", "dist/**", "build/**", "out/**", "coverage/**", ".git/**", "**/*.d.ts", "**/*.test.ts", "**/*.test.tsx", "**/*.spec.ts", "**/__tests__/**"]
FILE_NAME = "codestrata.json"


class ConfigError(ValueError):
    """A project's settings can't be read; they are never passed over in silence."""


@dataclass(frozen=True)
class Config:
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))
    report_thresholds: dict[str, float] = field(default_factory=lambda: dict(REPORT_THRESHOLDS))
    rules: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(OPTIONAL_RULES, False))
    include: tuple[str, ...] = tuple(INCLUDE)
    exclude: tuple[str, ...] = tuple(EXCLUDE)
    churn: dict[str, float] = field(default_factory=lambda: dict(CHURN))
    knip: dict[str, float] = field(default_factory=lambda: dict(KNIP))

    def is_on(self, rule: str) -> bool:
        """Optional rules are off unless switched on; all others are on."""
        return self.rules.get(rule, True)

    def report_level(self, rule: str) -> float | None:
        name = REPORT_LEVEL_OF.get(rule)
        return None if name is None else self.report_thresholds[name]

    def optional_rules_on(self) -> list[str]:
        return [r for r in OPTIONAL_RULES if self.rules[r]]


def _numbers(section: str, raw: Any, known: dict | None) -> dict[str, float]:
    if not isinstance(raw, dict):
        raise ConfigError(f"{section}: an object is expected")
    for key, value in raw.items():
        if known is not None and key not in known:
            raise ConfigError(f"{section}: {key} is not known")
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0:
            raise ConfigError(f"{section}.{key}: a number of at least 0 is expected")
    return raw


def _strings(name: str, raw: Any) -> tuple[str, ...]:
    if not isinstance(raw, list) or not all(isinstance(x, str) for x in raw):
        raise ConfigError(f"{name}: a list of strings is expected")
    return tuple(raw)


def resolve(raw: Any) -> Config:
    """Settings over the defaults, section by section. Unknown keys are an error in rules, reportThresholds and knip."""
    if not isinstance(raw, dict):
        raise ConfigError("an object is expected")
    out = Config()
    if "thresholds" in raw:
        out = replace(out, thresholds=THRESHOLDS | _numbers("thresholds", raw["thresholds"], None))
    if "reportThresholds" in raw:
        out = replace(out, report_thresholds=REPORT_THRESHOLDS | _numbers("reportThresholds", raw["reportThresholds"], REPORT_THRESHOLDS))
    if "churn" in raw:
        out = replace(out, churn=CHURN | _numbers("churn", raw["churn"], None))
    if "knip" in raw:
        out = replace(out, knip=KNIP | _numbers("knip", raw["knip"], KNIP))
    if "rules" in raw:
        rules = raw["rules"]
        if not isinstance(rules, dict):
            raise ConfigError("rules: an object is expected")
        for key, value in rules.items():
            if key not in OPTIONAL_RULES:
                raise ConfigError(f"rules: {key} is not known")
            if not isinstance(value, bool):
                raise ConfigError(f"rules.{key}: true or false is expected")
        out = replace(out, rules=out.rules | rules)
    if "scope" in raw:
        scope = raw["scope"]
        if not isinstance(scope, dict):
            raise ConfigError("scope: an object is expected")
        out = replace(out, **{k: _strings(f"scope.{k}", scope[k]) for k in ("include", "exclude") if k in scope})
    return out


def load(root: str | Path) -> Config:
    """The settings of a project; the defaults if it has no file for them."""
    path = Path(root) / FILE_NAME
    if not path.exists():
        return Config()
    try:
        return resolve(json.loads(path.read_text(encoding="utf-8")))
    except json.JSONDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e


def as_json(config: Config) -> dict:
    return {f.name: getattr(config, f.name) for f in fields(config)}
