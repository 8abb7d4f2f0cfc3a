"""What can fail, by stage; callers may catch the base."""

from __future__ import annotations


class QuillError(Exception):
    """Base of all below."""


class ParsingError(QuillError):
    """A document gave no text by any reader."""


class LowConfidenceError(QuillError):
    """A page's text is too poor to be relied on."""


class ExtractionError(QuillError):
    """A document's facts don't fit their schema."""


class RetrievalError(QuillError):
    """An index or a vector store couldn't be asked."""


class GenerationError(QuillError):
    """A model's answer couldn't be used."""


class DistillationError(QuillError):
    """No rules could be made of the edits."""


class ConfigurationError(QuillError):
    """A setting is missing or contradicts another."""


class ModelUnavailableError(QuillError):
    """No provider answered in time."""
