"""The errors of the engine."""

from __future__ import annotations


class QuillonError(Exception):
    """Base of all errors; ``status`` is the HTTP status a service should answer with."""

    status = 400
    code = "BAD_REQUEST"


class InvalidQuery(QuillonError):
    code = "INVALID_QUERY"


class EmptyQuery(InvalidQuery):
    pass


class NilQuery(InvalidQuery):
    pass


class TooManyClauses(InvalidQuery):
    pass


class QuerySyntaxError(InvalidQuery):
    def __init__(self, query: str, position: int, message: str):
        super().__init__(f"{message} (character {position + 1} of {query!r})")
        self.query, self.position = query, position


class BadSortField(InvalidQuery):
    pass


class UnsortableField(InvalidQuery):
    pass


class TooManySortKeys(InvalidQuery):
    pass


class NotNumericField(QuillonError):
    pass


class InvalidFieldValue(QuillonError):
    pass


class InvalidFieldKind(QuillonError):
    pass


class FieldKindConflict(QuillonError):
    pass


class EmptyExternalId(QuillonError):
    pass


class EmptyFieldName(QuillonError):
    pass


class NoFields(QuillonError):
    pass


class TooManyFields(QuillonError):
    pass


class DocumentTooLarge(QuillonError):
    pass


class UnsupportedFieldType(QuillonError):
    pass


class AmbiguousField(QuillonError):
    pass


class IntegerTooLarge(QuillonError):
    pass


class BadTableName(QuillonError):
    pass


class CannotDropDefault(QuillonError):
    pass


class TooManyTables(QuillonError):
    status, code = 409, "CONFLICT"


class TableExists(QuillonError):
    status, code = 409, "CONFLICT"


class TableNotFound(QuillonError):
    status, code = 404, "NOT_FOUND"


class DocumentExists(QuillonError):
    status, code = 409, "CONFLICT"


class DocumentNotFound(QuillonError):
    status, code = 404, "NOT_FOUND"


class NoDocuments(QuillonError):
    pass


class EngineClosed(QuillonError):
    status, code = 500, "INTERNAL"


class NoSharedFolder(QuillonError):
    status, code = 500, "INTERNAL"


class Busy(QuillonError):
    status, code = 503, "BUSY"


class PersistenceBroken(QuillonError):
    status, code = 500, "INTERNAL"


class Corrupted(QuillonError):
    status, code = 500, "INTERNAL"
