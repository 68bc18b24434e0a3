"""Values that the event log takes and returns, its limits and its errors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone
from enum import Enum
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import Column, DataFrame

#: Columns that the store adds to every row.
INDEX, PARTITION, CHUNK = "__index", "__partition", "__chunk"

#: A cursor: by partition the next offset (ascending) or the last one returned (descending).
Cursor = dict[str, int]


class EventLogError(Exception):
    """Base of all errors; ``status`` is the HTTP status that says the same."""

    status = 500

    def reply(self) -> dict:
        return {"message": str(self), "code": self.status}


class BadRequest(EventLogError):
    status = 400


class EmptyBody(BadRequest):
    pass


class InvalidQuery(BadRequest):
    pass


class InvalidSchema(BadRequest):
    pass


class NullTypes(InvalidSchema):
    pass


class PathError(BadRequest):
    """A path into nested columns that leads nowhere: ``kind`` is Empty, KeyMissing or NotStruct."""

    def __init__(self, kind: str, path: str = ""):
        super().__init__(f"{kind}: {path}" if path else kind)
        self.kind, self.path = kind, path


class Unacceptable(BadRequest):
    pass


class PayloadTooLarge(EventLogError):
    status = 413

    def __init__(self, size: int, limit: int):
        super().__init__(f"{size} bytes exceed the limit of {limit}")
        self.limit = limit


class WriterBusy(EventLogError):
    status = 429


class NoHeartbeat(EventLogError):
    pass


class DiskFull(EventLogError):
    pass


class QueueFull(EventLogError):
    status = 429


class EmptyStream(EventLogError):
    pass


class CannotReshape(EventLogError):
    pass


class Status(str, Enum):
    """Why a page ended."""

    ALL = "All"
    SCHEMA_CHANGE = "SchemaChange"
    RECORD_LIMITED = "RecordLimited"
    BYTE_LIMITED = "ByteLimited"


class Order(str, Enum):
    ASC = "asc"
    DESC = "desc"

    @classmethod
    def parse(cls, text: str | Order | None) -> Order:
        try:
            return text if isinstance(text, Order) else cls((text or "asc").lower())
        except ValueError:
            raise InvalidQuery(f"order must be asc or desc, not {text!r}") from None


@dataclass(frozen=True)
class Span:
    """Offsets ``start`` (included) to ``end`` (not included)."""

    start: int
    end: int

    def __len__(self) -> int:
        return self.end - self.start


@dataclass(frozen=True)
class RowLimit:
    max_records: int = 10_000
    max_bytes: int = 10_240_000

    @classmethod
    def records(cls, n: int) -> RowLimit:
        return cls(max_records=n)

    def min(self, other: RowLimit) -> RowLimit:
        return RowLimit(min(self.max_records, other.max_records), min(self.max_bytes, other.max_bytes))


#: Rows of a page whose size nobody states.
DEFAULT_PAGE = 1000


@dataclass(frozen=True)
class Focus:
    """What of each row to return; see ``operators.focus``."""

    dataset: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    separator: str | None = None
    max_bytes: int | None = None

    def __bool__(self) -> bool:
        return bool(self.dataset or self.exclude or self.separator is not None or self.max_bytes is not None)


@dataclass(frozen=True)
class TimeRange:
    """Milliseconds since the epoch, both ends included."""

    start: int
    end: int

    @classmethod
    def parse(cls, start: str, end: str | None) -> TimeRange:
        """RFC 3339 bounds. Rows have milliseconds, so the start rounds up and the end down."""

        def micros(text: str | None) -> int:
            try:
                when = datetime.fromisoformat(text or "")
            except (TypeError, ValueError):
                raise InvalidQuery(f"not an RFC 3339 time: {text!r}") from None
            if when.tzinfo is None:
                raise InvalidQuery(f"a time needs its offset: {text!r}")
            delta = when - datetime(1970, 1, 1, tzinfo=timezone.utc)
            return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds

        return cls(-(-micros(start) // 1000), micros(end) // 1000)


#: What a pattern may not use: the pattern language has no look-around and no references back.
_FOREIGN = re.compile(r"\(\?[=!<]|\\[1-9]|\(\?P=")
_LONGEST = 8192


@dataclass(frozen=True)
class Selector:
    """A partition's name, or ``regex:`` and a pattern to be found anywhere in it.

    A pattern that is not valid, or too long, is no error: the whole text, ``regex:`` included, is then compared as a name.
    """

    text: str

    @property
    def pattern(self) -> re.Pattern | None:
        if not self.text.startswith("regex:"):
            return None
        pattern = self.text[len("regex:") :]
        if len(pattern) > _LONGEST or _FOREIGN.search(pattern):
            return None
        try:
            return re.compile(pattern)
        except re.error:
            return None

    def matches(self, name: str) -> bool:
        pattern = self.pattern
        return name == self.text if pattern is None else pattern.search(name) is not None

    def column(self, name: Column) -> Column:
        pattern = self.pattern
        return name == self.text if pattern is None else name.rlike(pattern.pattern)


def selected(name: str, selectors: list[str] | None) -> bool:
    """Whether any selector matches; none at all (None) match everything, an empty list nothing."""
    return selectors is None or any(Selector(s).matches(name) for s in selectors)


@dataclass
class Page:
    """Rows as a lazy DataFrame in page order, why the page ended, and where to go on."""

    df: DataFrame | None
    status: Status
    next: Cursor = field(default_factory=dict)
    span: Span | None = None
    rows: int = 0
    metadata: dict[str, str] = field(default_factory=dict)

    def header(self) -> dict:
        return {"status": self.status.value, "next": self.next}
