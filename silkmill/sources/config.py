"""Configuration: defaults, file, command line, in this order; driver side."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field, fields, is_dataclass, replace
from logging.handlers import RotatingFileHandler
from pathlib import Path
from typing import ClassVar

MODES = ("static", "dynamic", "all")
#: Larger header files are refused.
MAX_HEADER_FILE = 1 << 20
#: Folder in the user's home.
CONFIG_HOME = ".silkmill"


class ConfigError(ValueError):
    """A setting is out of bounds; the message names it."""


@dataclass(frozen=True)
class CrawlConfig:
    """Settings of a crawl, by their names in the file; see ``BOUNDS``."""

    depth: int = 2
    wait_time: int = 3
    max_workers: int = 2
    playwright_tabs: int = 4
    headless: bool = True
    mode: str = "all"
    allow_cross_domain: bool = True
    resume: bool = False
    similarity_enabled: bool = True
    similarity_threshold: float = 0.8
    similarity_workers: int = 8
    batch_delay: int = 1
    continue_on_error: bool = True

    BOUNDS: ClassVar[dict] = {
        "depth": (1, 10), "wait_time": (0, 60), "max_workers": (1, 100), "playwright_tabs": (1, 20), "similarity_threshold": (0, 1),
    }

    def validate(self) -> CrawlConfig:
        for name, (low, high) in self.BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ConfigError(f"{name} must be between {low} and {high}")
        if self.mode not in MODES:
            raise ConfigError(f"mode must be one of {', '.join(MODES)}")
        return self


@dataclass(frozen=True)
class ResourceConfig:
    """Memory and processor bounds, by their names in the file."""

    safety_reserve_memory: int = 1024
    safety_threshold: int = 500
    cpu_load_threshold: int = 80
    max_tabs_limit: int = 16

    BOUNDS: ClassVar[dict] = {
        "safety_reserve_memory": (512, math.inf), "safety_threshold": (200, math.inf), "cpu_load_threshold": (50, 999), "max_tabs_limit": (1, 32),
    }

    def validate(self) -> ResourceConfig:
        for name, (low, high) in self.BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ConfigError(f"resource.{name} must be between {low} and {high}")
        return self


@dataclass(frozen=True)
class Rotation:
    """When log files are changed: megabytes, number, days."""

    max_size: int = 10
    max_backups: int = 3
    max_age: int = 28
    compress: bool = True


@dataclass(frozen=True)
class LoggingConfig:
    level: str = "info"
    log_dir: str = "logs"
    rotation: Rotation = field(default_factory=Rotation)


@dataclass(frozen=True)
class OutputConfig:
    base_dir: str = "output"
    domain_separation: bool = True


@dataclass(frozen=True)
class Config:
    """A whole configuration file."""

    crawl: CrawlConfig = field(default_factory=CrawlConfig)
    resource: ResourceConfig = field(default_factory=ResourceConfig)
    logging: LoggingConfig = field(default_factory=LoggingConfig)
    output: OutputConfig = field(default_factory=OutputConfig)


def max_tabs(free_mb: int, per_tab_mb: int, cpus: int, limit: int) -> int:
    """Tabs that fit: the least of memory, processors and limit, at least one."""
    return max(1, min(free_mb // per_tab_mb, cpus, limit))


def over(base, values: dict):
    """A dataclass with the known keys of a mapping, nested ones too; unknown keys and null values are ignored."""
    changes = {}
    for f in fields(base):
        value = values.get(f.name)
        if value is not None:
            old = getattr(base, f.name)
            changes[f.name] = over(old, value) if is_dataclass(old) else value
    return replace(base, **changes)


def from_mapping(values: dict, base: CrawlConfig | None = None) -> CrawlConfig:
    """Crawl settings over a base."""
    return over(base or CrawlConfig(), values)


def search_path() -> list[Path]:
    """Where a configuration is looked for, the first one found counts."""
    return [Path("configs/config.yaml"), Path("config.yaml"), Path.home() / CONFIG_HOME / "config.yaml"]


def load_all(path: str | None = None, flags: dict | None = None) -> Config:
    """Defaults, then a YAML file, then crawl flags.

    A named file must exist; without a name the search path's first one is read, if there is any.
    """
    if path and not Path(path).exists():
        raise ConfigError(f"{path} does not exist")
    found = Path(path) if path else next((p for p in search_path() if p.exists()), None)
    out = Config()
    if found:
        import yaml

        out = over(out, yaml.safe_load(found.read_text(encoding="utf-8")) or {})
    out = replace(out, crawl=from_mapping(flags or {}, out.crawl))
    out.crawl.validate()
    out.resource.validate()
    return out


def load(path: str | None = None, flags: dict | None = None) -> CrawlConfig:
    """The crawl settings of :func:`load_all`."""
    return load_all(path, flags).crawl


HEADER_TEMPLATE = """# Request headers: name and value, one a line.
# Names hold letters, digits and hyphens; the client sets Host, Content-Length, Transfer-Encoding and Connection itself.
headers: {}
"""


def load_headers(path: str) -> dict[str, str]:
    """The ``headers`` of a YAML file; a template is written where there is no file."""
    p = Path(path)
    if not p.exists():
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(HEADER_TEMPLATE, encoding="utf-8")
    if p.stat().st_size > MAX_HEADER_FILE:
        raise ConfigError(f"{path} has more than {MAX_HEADER_FILE} bytes")
    import yaml

    return {str(k): str(v) for k, v in ((yaml.safe_load(p.read_text(encoding="utf-8")) or {}).get("headers") or {}).items()}


def log_to(settings: LoggingConfig) -> logging.Logger:
    """A logger with a console, a rotating main file and a rotating file of errors."""
    Path(settings.log_dir).mkdir(parents=True, exist_ok=True)
    log = logging.getLogger("silkmill")
    log.setLevel({"trace": "DEBUG"}.get(settings.level, settings.level.upper()))
    size, n = settings.rotation.max_size << 20, settings.rotation.max_backups
    errors = RotatingFileHandler(Path(settings.log_dir) / "error.log", maxBytes=size, backupCount=n)
    errors.setLevel(logging.ERROR)
    log.handlers = [logging.StreamHandler(), RotatingFileHandler(Path(settings.log_dir) / "silkmill.log", maxBytes=size, backupCount=n), errors]
    return log
