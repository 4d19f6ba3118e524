"""Settings of an analysis: thresholds, architecture rules, scan filters."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

# Directories that scans skip, and decorator fragments that mark framework entry points.
EXCLUDE_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "env", ".env", "build", "dist", ".idea", ".vscode", ".mypy_cache", ".pytest_cache", ".tox", ".eggs", "site-packages", "egg-info")
FRAMEWORK_DECORATORS = (
    "pytest.fixture", "fixture", "pytest.mark",
    "app.get", "app.post", "app.put", "app.patch", "app.delete", "app.websocket", "app.middleware", "app.on_event",
    "router.get", "router.post", "router.put", "router.patch", "router.delete", "router.websocket",
    "app.route", "app.before_request", "app.after_request", "app.errorhandler", "bp.route",
    "admin.register", "receiver", "celery_app.task", "app.task", "shared_task",
    "click.command", "click.group", "cli.command", "cli.group", "event.listens_for",
    "staticmethod", "classmethod", "property", "abstractmethod", "dataclass", "attrs",
)
CONFIG_NAMES = ("girder.toml", "pyproject.toml")
IGNORE_FILE = ".girderignore"


@dataclass(frozen=True)
class Thresholds:
    """Limits of the health list, the insights and the risk labels (fixed values)."""

    profile: str = "default"
    instability_high: float = 0.8
    instability_low: float = 0.2
    ce_high: int = 8
    ca_high: int = 8
    cc_moderate: int = 5
    cc_elevated: int = 10
    cc_high: int = 20
    cc_critical: int = 50
    cog_moderate: int = 8
    cog_elevated: int = 15
    cog_high: int = 25
    cog_critical: int = 50
    loc_high: int = 300
    loc_critical: int = 500
    dependents_high: int = 5
    dependents_critical: int = 10
    dependencies_high: int = 6
    cycle_size_high: int = 4
    distance_high: float = 0.5
    distance_low: float = 0.2
    abstract_high: float = 0.8
    abstract_low: float = 0.2
    use_percentiles: bool = True
    cc_floor_critical: int = 30
    cc_floor_high: int = 15
    cog_floor_critical: int = 30
    cog_floor_high: int = 15
    ratio_python: float = 2.3
    ratio_javascript: float = 2.0
    ratio_typescript: float = 2.1

    @staticmethod
    def of(profile: str = "default", **changes: object) -> Thresholds:
        base = {"strict": STRICT, "relaxed": RELAXED}.get(profile, Thresholds())
        if not changes:
            return base
        return replace(base, **changes, profile="custom" if profile == "default" else f"{profile}+custom")


STRICT = Thresholds(
    profile="strict", cc_moderate=3, cc_elevated=7, cc_high=10, cc_critical=30, cog_moderate=5, cog_elevated=10, cog_high=15, cog_critical=30,
    loc_high=200, loc_critical=300, dependents_high=3, dependents_critical=5, ce_high=5, ca_high=5, dependencies_high=4,
)
RELAXED = Thresholds(
    profile="relaxed", cc_moderate=8, cc_elevated=15, cc_high=30, cc_critical=80, cog_moderate=12, cog_elevated=25, cog_high=40, cog_critical=80,
    loc_high=500, loc_critical=1000, dependents_high=10, dependents_critical=20, ce_high=12, ca_high=12, dependencies_high=10,
)


@dataclass(frozen=True)
class Rules:
    """Architecture rules. Layers run from bottom to top."""

    layers: tuple[str, ...] = ()
    allow: tuple[tuple[str, str], ...] = ()
    forbidden: tuple[tuple[str, tuple[str, ...]], ...] = ()
    protected: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = ()
    independence: tuple[tuple[str, ...], ...] = ()
    acyclic_siblings: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    project_name: str = ""
    exclude_dirs: tuple[str, ...] = EXCLUDE_DIRS
    exclude_patterns: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("python",)
    thresholds: Thresholds = field(default_factory=Thresholds)
    rules: Rules = field(default_factory=Rules)
    decorators: tuple[str, ...] = FRAMEWORK_DECORATORS
    tsconfig: str = ""
    package_root: str = ""
    max_depth: int | None = None


_ALIASES = {"py": "python", "js": "javascript", "ts": "typescript"}


def normal_languages(names: list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
    """Aliases spelt out; unknown names dropped; Python where none is left."""
    known = [_ALIASES.get(n.strip().lower(), n.strip().lower()) for n in names or ()]
    return tuple(dict.fromkeys(n for n in known if n in {"python", "javascript", "typescript"})) or ("python",)


def from_mapping(raw: dict) -> Settings:
    """Settings from a parsed TOML table."""
    scan, rules = raw.get("scan", raw.get("project", {})), raw.get("rules", {})
    limits = dict(raw.get("thresholds", {}))
    profile = limits.pop("profile", "default")
    limits |= {f"ratio_{language}": ratio for language, ratio in limits.pop("token_ratios", {}).items()}
    scripts = [s for s in scan.get("language", {}).values() if isinstance(s, dict)]
    names = {f.name for f in fields(Thresholds)}
    entry = scan.get("framework_decorators", raw.get("symbols", {}).get("framework_decorators", raw.get("framework_decorators")))
    decorators = FRAMEWORK_DECORATORS
    if isinstance(entry, list):
        decorators = tuple(dict.fromkeys((*FRAMEWORK_DECORATORS, *entry)))
    elif isinstance(entry, dict):
        own = entry.get("replace", False)  # a flag beside ``add``, or the list itself
        if isinstance(own, bool):
            decorators = tuple(dict.fromkeys((*(() if own else FRAMEWORK_DECORATORS), *entry.get("add", ()))))
        else:
            decorators = tuple(own)
    layers = rules.get("layers", {})
    return Settings(
        project_name=raw.get("project", {}).get("name", ""),
        exclude_dirs=tuple(scan.get("exclude_dirs", EXCLUDE_DIRS)),
        exclude_patterns=tuple(scan.get("exclude", scan.get("exclude_patterns", ()))),
        include_patterns=tuple(scan.get("include", scan.get("include_patterns", ()))),
        languages=normal_languages(scan.get("languages")),
        thresholds=Thresholds.of(profile, **{k: v for k, v in limits.items() if k in names}),
        rules=Rules(
            layers=tuple(layers.get("order", ())),
            allow=tuple((a["from"], a["to"]) for a in layers.get("allow", ())),
            forbidden=tuple((r["from"], tuple(r["to"] if isinstance(r["to"], list) else [r["to"]])) for r in rules.get("forbidden", ())),
            protected=tuple((tuple(r["modules"]), tuple(r.get("allowed_importers", ()))) for r in rules.get("protected", ())),
            independence=tuple(tuple(g) for g in rules.get("independence", ())),
            acyclic_siblings=tuple(r.get("ancestor", "") for r in rules.get("acyclic_siblings", ())),
        ),
        decorators=decorators,
        tsconfig=next((s["tsconfig"] for s in scripts if s.get("tsconfig")), ""),
        package_root=next((s["package_root"] for s in scripts if s.get("package_root")), ""),
        max_depth=raw.get("analysis", {}).get("max_depth"),
    )


def _read(path: Path) -> dict | None:
    """The settings in a file; None if a project file has none."""
    raw = tomllib.loads(path.read_text(encoding="utf-8"))
    return raw.get("tool", {}).get("girder") if path.name == "pyproject.toml" else raw


def find_settings(start: str | Path, config: str | Path | None = None) -> Settings:
    """``config``, or the first settings file from ``start`` upwards, with the ignore file of ``start``."""
    start = Path(start).resolve()
    found = from_mapping(_read(Path(config)) or {}) if config else Settings()
    for folder in () if config else (start, *start.parents):
        for name in CONFIG_NAMES:
            if (p := folder / name).is_file():
                raw = _read(p)
                if raw is not None:
                    found = from_mapping(raw)
                    break
        else:
            continue
        break
    ignore = start / IGNORE_FILE
    if ignore.is_file():
        lines = (x.strip() for x in ignore.read_text(encoding="utf-8").splitlines())
        found = replace(found, exclude_patterns=(*found.exclude_patterns, *(x for x in lines if x and not x.startswith("#"))))
    return found
