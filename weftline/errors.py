"""Error taxonomy."""

from __future__ import annotations


class WeftlineError(Exception):
    """Root of all errors raised here."""


class ValidationError(WeftlineError):
    """A request breaks its rules; ``violations`` maps fields to messages."""

    def __init__(self, message: str, violations: dict[str, list[str]] | None = None):
        super().__init__(message)
        self.violations = violations or {}


class ConfigurationError(WeftlineError):
    """A setting is out of range."""


class ParseError(WeftlineError):
    """A source file cannot be parsed."""


class IndexingError(WeftlineError):
    """A corpus cannot be indexed."""


class GraphError(WeftlineError):
    """A graph is malformed."""


class AdapterError(WeftlineError):
    """An outside service failed."""


class AdapterTimeout(AdapterError):
    """An outside service took too long."""


class AdapterRateLimit(AdapterError):
    """An outside service refused for now."""


class BudgetExceeded(WeftlineError):
    """A result does not fit its token budget."""


class LanguageNotSupported(WeftlineError):
    """No parser is registered for a language."""
