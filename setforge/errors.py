"""Errors of the library; all are SetforgeError."""


class SetforgeError(Exception):
    pass


class InvalidPath(SetforgeError):
    """A path or an entry name that is missing or unsafe."""


class InvalidHash(SetforgeError):
    pass


class ArchiveError(SetforgeError):
    """An archive that cannot be read, or lacks an entry."""


class CatalogueError(SetforgeError):
    """A catalogue that is unknown or cannot be parsed."""


class PlanError(SetforgeError):
    """A plan that must not be written."""
