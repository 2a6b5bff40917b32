"""A user's configuration: the root, which folders play which role, and optional embeddings."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from .errors import ConfigMissing, Refused

ROLES = ("document", "image", "markdown", "code", "misc")


@dataclass(frozen=True)
class Config:
    root: str
    roles: dict[str, tuple[str, ...]] = field(default_factory=dict)
    own_owners: tuple[str, ...] = ()
    generated_dirs: tuple[str, ...] = ()
    index_file: str | None = None
    embeddings: dict | None = None

    def dirs(self, role: str) -> tuple[str, ...]:
        return tuple(os.path.normpath(os.path.join(self.root, d)) for d in self.roles.get(role, ()))

    def fingerprint(self) -> str:
        """Changes when the root or a role does; a store built under another one is not updated."""
        return hashlib.sha256(json.dumps([self.root, sorted((k, list(v)) for k, v in self.roles.items())]).encode()).hexdigest()[:32]


def load(path: str) -> Config:
    try:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise ConfigMissing(f"there is no configuration at {path}") from None
    except tomllib.TOMLDecodeError as e:
        raise Refused(f"{path} is no TOML: {e}") from e
    if not isinstance(data.get("root"), str):
        raise Refused(f"{path} names no root")
    roles = data.get("roles", {})
    unknown = sorted(set(roles) - set(ROLES))
    if unknown:
        raise Refused(f"unknown roles: {', '.join(unknown)}; there are {', '.join(ROLES)}")
    emb = data.get("embeddings")
    if emb is not None and (lacking := [k for k in ("provider", "model", "dim", "locator") if k not in emb]):
        raise Refused(f"the embeddings block lacks {', '.join(lacking)}")
    return Config(
        os.path.normpath(os.path.expanduser(data["root"])), {k: tuple(v) for k, v in roles.items()}, tuple(data.get("vendored", {}).get("own_owners", ())),
        tuple(data.get("markdown", {}).get("generated_dirs", ())), data.get("markdown", {}).get("index_file"), emb,
    )


def render(c: Config) -> str:
    lines = [f"root = {json.dumps(c.root)}", "", "[roles]", *[f"{k} = {json.dumps(list(v))}" for k, v in c.roles.items()]]
    lines += ["", "[vendored]", f"own_owners = {json.dumps(list(c.own_owners))}", "", "[markdown]", f"generated_dirs = {json.dumps(list(c.generated_dirs))}"]
    lines += [f"index_file = {json.dumps(c.index_file)}"] if c.index_file else []
    if c.embeddings:
        lines += ["", "[embeddings]", *[f"{k} = {json.dumps(v)}" for k, v in c.embeddings.items()]]
    return "\n".join(lines) + "\n"


def write(c: Config, path: str, overwrite: bool = False) -> None:
    """Whole or not at all, and on disk when this returns."""
    if os.path.exists(path) and not overwrite:
        raise Refused(f"{path} exists")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        f.write(render(c))
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
