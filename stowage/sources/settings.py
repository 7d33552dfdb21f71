"""Settings: targets and limits from a mapping (a parsed file) with environment variables over it."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from ..operators.content import Store

CODECS, TYPES = ("none", "zstd"), ("filesystem", "s3")
MOST_NAME, MOST_CONCURRENCY = 64, 1024


@dataclass(frozen=True)
class Target:
    name: str
    type: str = "filesystem"
    root: str = ""
    codec: str = "none"
    worm: bool = False
    bucket: str = ""
    endpoint: str = ""
    tls: bool = True
    sse: str = ""
    audit_key: str = ""
    audit_secret: str = ""

    def store(self) -> Store:
        """The store, in a path that every task reaches; s3 needs a mounted or Hadoop-readable root."""
        return Store(self.name, self.root, self.codec, self.worm)


@dataclass(frozen=True)
class Settings:
    targets: tuple[Target, ...] = ()
    concurrency: int = 8
    object_timeout_s: int = 1800
    stale_s: int = 3600
    max_attempts: int = 10
    max_deliveries: int = 50
    circuit_threshold: int = 5
    circuit_cooldown_s: int = 60
    manifest_every_s: int = 0
    extra: dict = field(default_factory=dict, hash=False)


def env_name(name: str) -> str:
    return re.sub("[^A-Z0-9]", "_", name.upper())


def load(found: Mapping, env: Mapping[str, str] | None = None, prefix: str = "STOWAGE") -> Settings:
    """Settings from a mapping; <prefix>_<FIELD> and <prefix>_TARGET_<NAME>_<FIELD> win, <prefix>_TARGETS lists targets to add."""
    env = env or {}
    base = Settings()

    def value(have, key: str):
        if key not in env:
            return have
        kind = type(have)
        return env[key].lower() in ("1", "true", "yes") if kind is bool else kind(env[key])

    limits = {f: value(found.get(f, getattr(base, f)), f"{prefix}_{f.upper()}") for f in Settings.__dataclass_fields__ if f not in ("targets", "extra")}
    targets = {t["name"]: Target(**t) for t in found.get("targets", ())}
    for name in filter(None, (x.strip() for x in env.get(f"{prefix}_TARGETS", "").split(","))):
        targets.setdefault(name, Target(name))
    own = [replace(t, **{f: value(getattr(t, f), f"{prefix}_TARGET_{env_name(t.name)}_{f.upper()}") for f in Target.__dataclass_fields__ if f != "name"}) for t in targets.values()]
    return Settings(targets=tuple(own), **limits)


def faults(s: Settings) -> list[str]:
    """What is wrong with the settings, all of it."""
    found = []
    if not s.targets:
        found.append("no targets")
    if not 1 <= s.concurrency <= MOST_CONCURRENCY:
        found.append(f"concurrency must be 1 to {MOST_CONCURRENCY}")
    found += [f"{f} must be positive" for f in ("object_timeout_s", "stale_s", "max_attempts", "max_deliveries", "circuit_threshold", "circuit_cooldown_s") if getattr(s, f) <= 0]
    if s.stale_s <= s.object_timeout_s:
        found.append("stale_s must be larger than object_timeout_s, or a claim is taken away from a worker that is at it")
    names: dict[str, str] = {}
    for t in s.targets:
        if not t.name or len(t.name) > MOST_NAME:
            found.append(f"target name {t.name!r} must have 1 to {MOST_NAME} characters")
        if (other := names.setdefault(env_name(t.name), t.name)) != t.name or [x.name for x in s.targets].count(t.name) > 1:
            found.append(f"targets {other!r} and {t.name!r} have the same variables")
        if t.type not in TYPES:
            found.append(f"target {t.name}: unknown type {t.type!r}")
        if t.codec not in ("", *CODECS):
            found.append(f"target {t.name}: unknown codec {t.codec!r}")
        if t.type == "filesystem" and not t.root:
            found.append(f"target {t.name}: no root")
        if t.type == "s3":
            if not t.bucket:
                found.append(f"target {t.name}: no bucket")
            if t.sse and not t.tls:
                found.append(f"target {t.name}: encryption keys need TLS")
            if bool(t.audit_key) != bool(t.audit_secret):
                found.append(f"target {t.name}: an audit key needs its secret")
    places = [(t.type, t.root or t.bucket, t.endpoint) for t in s.targets]
    found += [f"targets share a place: {p}" for p in sorted(set(p for p in places if places.count(p) > 1))]
    return list(dict.fromkeys(found))


def read_target(targets: tuple[Target, ...], name: str = "") -> Target:
    """The target to read from: the named one, else the first that isn't write-once."""
    found = next((t for t in targets if (t.name == name if name else not t.worm)), None)
    if found is None:
        raise LookupError(f"no target {name!r}" if name else "all targets are write-once; name one")
    return found
