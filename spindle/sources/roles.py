"""A proposed configuration for a root: which of its folders are of mostly one category."""

from __future__ import annotations

import os
from collections import Counter

from ..config import Config
from ..operators.reports import ROLE_LEAST, ROLE_SHARE
from ..plans.classifier import load_rules


def proposed(root: str) -> Config:
    """Each folder at the top of the root gets the category of more than half of all its files, three of them or more; a tie gets none."""
    rules = load_rules()
    ext = {e: label for label in ("image", "markdown", "code") for e in rules["extensions"][label]} | dict.fromkeys(rules["extensions"]["document"], "document")
    skip = {*rules["cache"]["dirs"], *rules["dependencies"]["dirs"]}
    roles: dict[str, list[str]] = {}
    root = os.path.abspath(os.path.expanduser(root))
    for name in sorted(os.listdir(root)):
        if name.startswith(".") or name in skip or not os.path.isdir(os.path.join(root, name)):
            continue
        counts: Counter = Counter()
        for _, dirs, names in os.walk(os.path.join(root, name)):
            dirs[:] = [d for d in dirs if d not in skip]
            counts.update(ext.get(n.rpartition(".")[2].lower() if "." in n[1:] else "", "misc") for n in names)
        total = sum(counts.values())
        for role, n in counts.items():
            if role != "misc" and n >= ROLE_LEAST and n > ROLE_SHARE * total:
                roles.setdefault(role, []).append(name)
    return Config(root, {k: tuple(v) for k, v in roles.items()})
