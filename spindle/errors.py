"""Refusals. Each is a named error; nothing is silently approximated."""


class Refused(Exception):
    """Base of all refusals; command-line entry points turn it into exit code 2."""


class QueryError(Refused):
    """A query asks for what the language or the store doesn't have; `missing` names it."""

    def __init__(self, message: str, missing: str | None = None) -> None:
        super().__init__(message)
        self.missing = missing


class AmbiguousKey(Refused):
    def __init__(self, key: str, candidates: list[str]) -> None:
        super().__init__(f"{key!r} is found under {len(candidates)} prefixes: {', '.join(candidates)}")
        self.candidates = candidates


class ModelUnavailable(Refused): ...


class UnknownMethod(Refused, ValueError): ...


class NotBuilt(Refused): ...


class ConfigChanged(Refused): ...


class CannotUpdate(Refused): ...


class Locked(Refused): ...


class OutsideRoot(Refused): ...


class ExportError(Refused): ...


class ImportRefused(Refused): ...


class ConfigMissing(Refused): ...


class EmbeddingRefused(Refused, ValueError): ...
