"""Errors that become data in a result."""


class PhoneticsError(Exception):
    """Base of all of them."""


class ConfigurationError(PhoneticsError):
    pass


class NormalizationError(PhoneticsError):
    pass


class BackendError(PhoneticsError):
    pass


class AlignmentError(BackendError):
    pass


class TranscriptionError(PhoneticsError):
    pass
