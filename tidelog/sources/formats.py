"""Forms in which rows come in and go out: Arrow, JSON records, and the old (time, message) records."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import BadRequest, EmptyBody, InvalidSchema, Page, PayloadTooLarge, Unacceptable

# Content types.
ARROW = "application/vnd.apache.arrow.file"
JSON = "application/json"
PANDAS = "application/json; format=pandas-records"


def read_body(body: bytes, content_type: str | None, max_bytes: int) -> pa.Table:
    """The table in an Arrow file sent to be appended, all batches as one."""
    if content_type != ARROW:
        raise BadRequest(f"content type must be {ARROW}")
    if len(body) > max_bytes:
        raise PayloadTooLarge(len(body), max_bytes)
    try:
        table = pa.ipc.open_file(io.BytesIO(body)).read_all()
    except pa.ArrowInvalid as e:
        raise BadRequest(f"not an Arrow file: {e}") from None
    if table.num_rows == 0:
        raise EmptyBody("no body provided")
    return table


def arrow_file(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def json_records(df: DataFrame) -> DataFrame:
    """A JSON object for each row, nulls written out, in column ``record``."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def reply(page: Page, accept: str | None = None) -> tuple[bytes, str, dict[str, str]]:
    """Body, content type and headers for a page: JSON records unless Arrow is asked for. An empty page has no status header."""
    kind = (accept or "*/*").split(",")[0].strip()
    import json

    status = {"x-iteration-status": json.dumps(page.header())} if page.rows else {}
    if kind == ARROW:
        table = page.df.toArrow() if page.rows else pa.table({})
        meta = {k.encode(): v.encode() for k, v in page.metadata.items()}
        if page.rows:
            meta[b"status"] = json.dumps(page.header() if page.span is None else page.status.value).encode()
            if page.span is not None:
                meta[b"span"] = json.dumps({"start": page.span.start, "end": page.span.end}).encode()
        return arrow_file(table.replace_schema_metadata(meta)), ARROW, status
    if kind in ("*/*", JSON, PANDAS) or kind.startswith(JSON):
        rows = [r["record"] for r in json_records(page.df).collect()] if page.rows else []  # a page is bounded
        return ("[" + ",".join(rows) + "]").encode(), JSON, status
    raise Unacceptable(f"cannot answer in {kind}")


def legacy_records(df: DataFrame) -> DataFrame:
    """``time, message`` of rows that have both; the second column must be a string named ``message``."""
    if len(df.columns) < 2 or df.columns[1] != "message" or not isinstance(df.schema["message"].dataType, T.StringType):
        raise InvalidSchema("the second column must be the string 'message'")
    return df.select("time", "message").na.drop()


def from_legacy(spark, records: list[tuple[int, str]]) -> DataFrame:
    kinds = T.StructType([T.StructField("time", T.LongType(), False), T.StructField("message", T.StringType(), False)])
    return spark.createDataFrame(records, kinds)
