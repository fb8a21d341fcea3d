"""Limits and configurations with their checks, and a registry of named plugins (PLT-7, CFG-1, CFG-2, FUN-5, AGG-27)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from quarry.errors import require

MIB = 1 << 20


@dataclass(frozen=True)
class Limits:
    """What one intake may hold."""

    archive_bytes: int = 200 * MIB
    unpacked_bytes: int = 1024 * MIB
    member_bytes: int = 16 * MIB
    members: int = 50_000
    ratio: float = 120.0
    source_file_bytes: int = 4 * MIB
    source_files: int = 25_000
    archive_suffixes: tuple[str, ...] = (".zip",)
    clone_seconds: float = 600.0
    hosts: tuple[str, ...] = ("github.com", "gitlab.com", "bitbucket.org")
    any_host: bool = False

    def __post_init__(self) -> None:
        sizes = (self.archive_bytes, self.unpacked_bytes, self.member_bytes, self.members, self.source_file_bytes, self.source_files, self.clone_seconds)
        require(min(sizes) > 0 and self.ratio > 1, "configuration_error", "limits are positive and the ratio is above 1")
        require(self.member_bytes <= self.unpacked_bytes, "configuration_error", "a member cannot be larger than all members")
        require(self.archive_bytes <= self.unpacked_bytes, "configuration_error", "an archive cannot be larger than its contents")


@dataclass(frozen=True)
class Sampling:
    """How many controls a review bundle gets for its findings."""

    ratio: float = 1.0
    minimum: int = 10
    seed: int = 42
    snippet_lines: int = 400

    def __post_init__(self) -> None:
        require(self.ratio >= 0 and self.minimum >= 0 and self.snippet_lines >= 1, "configuration_error", "ratio and minimum are not negative, and snippets have a line at least")


@dataclass(frozen=True)
class Training:
    """What a training run does."""

    models: tuple[str, ...] = ("logistic", "random_forest")
    test_size: float = 0.2
    seed: int = 42
    threshold: float = 0.5
    min_samples: int = 10
    min_projects: int = 2
    tries: int = 256
    trees: int = 200

    def __post_init__(self) -> None:
        known = {"logistic", "random_forest", "gradient_boosting", "decision_tree"}
        require(self.models and set(self.models) <= known, "configuration_error", f"models are some of {sorted(known)}")
        require(0 < self.test_size < 1 and 0 < self.threshold < 1, "configuration_error", "test_size and threshold lie between 0 and 1")
        require(self.min_samples >= 2 and self.min_projects >= 2 and self.tries >= 1 and self.trees >= 1, "configuration_error", "two samples, two projects, one try and one tree at least")


@dataclass(frozen=True)
class Settings:
    """All of the above, and what a production deployment must not have."""

    environment: str = "development"
    debug: bool = False
    keep_workspaces: bool = False
    limits: Limits = field(default_factory=Limits)
    sampling: Sampling = field(default_factory=Sampling)
    training: Training = field(default_factory=Training)
    report_rows: int = 10_000
    top_features: int = 8
    upload_bytes: int = 200 * MIB
    upload_suffixes: tuple[str, ...] = (".zip", ".py")
    job_attempts: int = 3
    stale_seconds: int = 900

    def __post_init__(self) -> None:
        require(self.environment in ("development", "test", "staging", "production"), "configuration_error", f"unknown environment {self.environment!r}")
        require(min(self.report_rows, self.top_features, self.upload_bytes, self.job_attempts, self.stale_seconds) > 0, "configuration_error", "limits are positive")
        if self.environment == "production":
            for wrong, what in ((self.debug, "debug"), (self.keep_workspaces, "keep_workspaces"), (self.limits.any_host, "limits.any_host")):
                require(not wrong, "configuration_error", f"{what} must be off in production")


class Registry:
    """Named plugins of one kind; a name is taken once."""

    def __init__(self, kind: str) -> None:
        self.kind, self._held = kind, {}

    def add(self, name: str, plugin: Any) -> Any:
        require(name not in self._held, "duplicate_registration", f"{self.kind} {name!r} is registered already")
        self._held[name] = plugin
        return plugin

    def get(self, name: str) -> Any:
        require(name in self._held, "unknown_plugin", f"there is no {self.kind} {name!r}", known=sorted(self._held))
        return self._held[name]

    def __contains__(self, name: str) -> bool:
        return name in self._held

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._held))

    def __len__(self) -> int:
        return len(self._held)
