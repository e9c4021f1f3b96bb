"""What can go wrong, by kind."""


class TidemarkError(Exception):
    """Any failure of this library."""


class DataError(TidemarkError, ValueError):
    """Input is missing, malformed or contradicts itself."""


class PolicyError(TidemarkError):
    """A source, use or output is against the policy."""


class SourceNotAllowed(PolicyError, ValueError):
    """A source may not be used for this market and dataset."""


class CoverageError(TidemarkError):
    """A range has no validated coverage."""
