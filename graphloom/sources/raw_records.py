"""Load raw delimited and JSON-lines records, setting apart those that fail.

Method: every Arrow batch is handed to the pyarrow CSV reader with an
invalid-row callback, which collects the rows of a wrong width; all fields are
read as strings and then cast column by column with vector kernels, and the
cells that fail name the column. Broken RFC 4180 quoting, which that reader
would silently repair, is found beforehand with one vector regular expression.
JSON lines are decoded strictly (RFC 8259).

Input: ``lines(file_no, line_no, line)`` and ``files(file_no, layout, format,
delimiter)``; other columns are ignored. A line belongs to the file row with
the latest ``loaded_at``. A trailing CR belongs to the line end; line 1 of a
CSV file is its header; a null line is an empty one; a null delimiter of a CSV
file is a comma. Lines of a file that is not listed, or has an unknown layout,
get the reason ``unknown_layout``. JSON nested deeper than the decoder's limit
(about a thousand levels) counts as not decodable. Empty tables give an empty result.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of each layout, in file order.
LAYOUTS = {
    "copy_outcome": ("copy_id", "target", "kind", "count", "finished_at"),
    "node_body": ("node_id", "label", "props"),
}
MAX_INT64 = "9223372036854775807"
KINDS = ("nodes", "relationships")

RESULT = pa.schema(
    [
        ("file_no", pa.int32()),
        ("line_no", pa.int32()),
        ("layout", pa.string()),
        ("reason", pa.string()),
        ("failed_column", pa.string()),
        ("line", pa.string()),
        ("copy_id", pa.int64()),
        ("target", pa.string()),
        ("kind", pa.string()),
        ("count", pa.int64()),
        ("finished_at", pa.timestamp("us")),
        ("node_id", pa.int64()),
        ("label", pa.string()),
        ("labels", pa.list_(pa.string())),
        ("props", pa.string()),
    ]
)
RESULT_DDL = (
    "file_no int, line_no int, layout string, reason string, failed_column string, line string, "
    "copy_id bigint, target string, kind string, count bigint, finished_at timestamp_ntz, "
    "node_id bigint, label string, labels array<string>, props string"
)


def _no_constant(word: str):
    raise ValueError(f"{word} is not JSON")


_strict = json.JSONDecoder(parse_constant=_no_constant, parse_int=str, parse_float=str)


def strict_json(text: str) -> tuple[bool, object]:
    """Whether `text` is exactly one RFC 8259 text, and its value (numbers stay text)."""
    try:
        return True, _strict.decode(text)
    except (ValueError, RecursionError):
        return False, None


class _Number(str):
    """A JSON number, told apart from a JSON string."""


_typed = json.JSONDecoder(parse_constant=_no_constant, parse_int=_Number, parse_float=_Number)


def _quoting_pattern(delimiter: str) -> str:
    d = re.escape(delimiter)
    field = f'(?:"(?:[^"]|"")*"|[^"{d}]*)'
    return f"^{field}(?:{d}{field})*$"


def _unused_char(text: pa.Array, start: int) -> str:
    """A private-use character that no line of the batch holds."""
    for code in range(start, 0xF8FF):
        if not pc.any(pc.match_substring(text, chr(code))).as_py():
            return chr(code)
    raise ValueError("no free private-use character")


def _csv_columns(lines: pa.Array, delimiter: str, names: tuple[str, ...]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Indexes of the lines that have the right number of fields, and their fields as strings."""
    empty = np.asarray(pc.equal(pc.utf8_length(lines), 0))
    if len(names) == 1:
        empty[:] = False
    kept = np.flatnonzero(~empty)
    if not len(kept):
        return kept, {n: pa.array([], pa.string()) for n in names}
    text = lines.take(pa.array(kept))
    # A record may hold line breaks; the reader sees stand-ins, so that one line stays one record.
    lf, cr = _unused_char(text, 0xE000), _unused_char(text, 0xE800)
    breaks = pc.any(pc.match_substring_regex(text, "[\r\n]")).as_py()
    if breaks:
        text = pc.replace_substring(pc.replace_substring(text, "\n", lf), "\r", cr)
    data = "\n".join(text.to_pylist()).encode() + b"\n"
    rejected: list[int] = []

    def on_invalid(row: pacsv.InvalidRow) -> str:
        rejected.append(row.number - 1)
        return "skip"

    read = pacsv.read_csv(
        pa.BufferReader(data),
        read_options=pacsv.ReadOptions(column_names=list(names), use_threads=False, block_size=max(1 << 20, len(data) + 1)),
        parse_options=pacsv.ParseOptions(
            delimiter=delimiter, ignore_empty_lines=False, newlines_in_values=False, invalid_row_handler=on_invalid
        ),
        convert_options=pacsv.ConvertOptions(
            column_types={n: pa.string() for n in names}, strings_can_be_null=False, quoted_strings_can_be_null=False
        ),
    )
    good = np.ones(len(kept), bool)
    good[rejected] = False
    columns = {}
    for n in names:
        column = read[n].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        if breaks:
            column = pc.replace_substring(pc.replace_substring(column, lf, "\n"), cr, "\r")
        columns[n] = column
    return kept[good], columns


def _is_int64(column: pa.Array) -> np.ndarray:
    digits = np.asarray(pc.match_substring_regex(column, "^[0-9]+$"))
    bare = pc.utf8_ltrim(column, "0")
    length = np.asarray(pc.utf8_length(bare))
    fits = (length < 19) | ((length == 19) & np.asarray(pc.less_equal(bare, MAX_INT64)))
    return digits & fits


def _to_int64(column: pa.Array, good: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(good), column, pa.scalar(None, pa.string())).cast(pa.int64())


_MOMENT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"


def _moments(column: pa.Array) -> list[dt.datetime | None]:
    shaped = np.asarray(pc.match_substring_regex(column, _MOMENT))
    out: list[dt.datetime | None] = []
    for ok, text in zip(shaped, column.to_pylist()):
        moment = None
        if ok:
            try:
                moment = dt.datetime.fromisoformat(text[:-1]) if text[11:13] != "24" else None
            except ValueError:
                pass
        out.append(moment)
    return out


def _copy_outcomes(c: dict[str, pa.Array]) -> tuple[dict[str, np.ndarray], dict[str, pa.Array]]:
    moments = _moments(c["finished_at"])
    good = {
        "copy_id": _is_int64(c["copy_id"]),
        "target": np.asarray(pc.not_equal(c["target"], "")),
        "kind": np.asarray(pc.is_in(c["kind"], pa.array(KINDS))),
        "count": _is_int64(c["count"]),
        "finished_at": np.array([m is not None for m in moments], bool),
    }
    typed = {
        "copy_id": _to_int64(c["copy_id"], good["copy_id"]),
        "target": c["target"],
        "kind": c["kind"],
        "count": _to_int64(c["count"], good["count"]),
        "finished_at": pa.array(moments, pa.timestamp("us")),
    }
    return good, typed


def _node_bodies(c: dict[str, pa.Array]) -> tuple[dict[str, np.ndarray], dict[str, pa.Array]]:
    props = np.array([p == "" or isinstance(strict_json(p)[1], dict) for p in c["props"].to_pylist()], bool)
    good = {
        "node_id": _is_int64(c["node_id"]),
        "label": np.asarray(pc.not_equal(c["label"], "")),
        "props": props,
    }
    return good, {"node_id": _to_int64(c["node_id"], good["node_id"]), "label": c["label"], "props": c["props"]}


_CSV_CHECKS = {"copy_outcome": _copy_outcomes, "node_body": _node_bodies}


def _part(base: pa.Table, layout: str, reason, failed=None, typed: dict | None = None) -> pa.Table:
    """Result rows for the lines of `base`; `reason` is one text for all or an array."""
    n = base.num_rows
    fill = lambda x: pa.array([x] * n, pa.string()) if x is None or isinstance(x, str) else x
    reasons = fill(reason)
    loads = pc.is_null(reasons)
    columns = {
        "file_no": base["file_no"],
        "line_no": base["line_no"],
        "layout": fill(layout),
        "reason": reasons,
        "failed_column": fill(failed),
        "line": pc.if_else(loads, pa.scalar(None, pa.string()), base["line"]),
    }
    for field in RESULT:
        if field.name not in columns:
            values = (typed or {}).get(field.name)
            columns[field.name] = (
                pa.nulls(n, field.type) if values is None else pc.if_else(loads, values, pa.scalar(None, field.type))
            )
    return pa.table([columns[f.name] for f in RESULT], schema=RESULT)


def _csv_part(rows: pa.Table, layout: str, delimiter: str) -> Iterator[pa.Table]:
    lines = rows["line"].combine_chunks() if isinstance(rows["line"], pa.ChunkedArray) else rows["line"]
    quoted = np.asarray(pc.match_substring_regex(lines, _quoting_pattern(delimiter)))
    if not quoted.all():
        yield _part(rows.filter(pa.array(~quoted)), layout, "quoting")
        rows = rows.filter(pa.array(quoted))
        lines = lines.filter(pa.array(quoted))
    if not rows.num_rows:
        return
    kept, columns = _csv_columns(lines, delimiter, LAYOUTS[layout])
    wrong = np.ones(rows.num_rows, bool)
    wrong[kept] = False
    if wrong.any():
        yield _part(rows.filter(pa.array(wrong)), layout, "column_count")
    if len(kept):
        good, typed = _CSV_CHECKS[layout](columns)
        failed = np.full(len(kept), None, object)
        for name in reversed(LAYOUTS[layout]):
            failed[~good[name]] = name
        reason = pa.array(np.where(failed == None, None, "invalid_value"), pa.string())  # noqa: E711
        yield _part(rows.take(pa.array(kept)), layout, reason, pa.array(failed, pa.string()), typed)


def _json_failure(value: object) -> str | None:
    """The first member of a JSON-lines node body that is not as it must be."""
    if not isinstance(value, dict):
        return "record"
    label, labels = value.get("label"), value.get("labels", [])
    if label is not None and (not isinstance(label, str) or isinstance(label, _Number) or not label):
        return "label"
    if not isinstance(labels, list) or any(not isinstance(x, str) or isinstance(x, _Number) for x in labels):
        return "labels"
    if label is None and not any(labels):
        return "label"
    if not isinstance(value.get("props", {}), dict):
        return "props"
    return None


def _dump(value: object) -> str:
    """Canonical JSON text in which numbers keep their spelling."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _jsonl_part(rows: pa.Table) -> Iterator[pa.Table]:
    reasons, failed, label, labels, props = [], [], [], [], []
    for line in rows["line"].to_pylist():
        try:
            value, why, cell = _typed.decode(line), None, None
            if cell := _json_failure(value):
                why = "invalid_value"
        except (ValueError, RecursionError):
            value, why, cell = None, "bad_json", None
        ok = why is None
        reasons.append(why)
        failed.append(cell)
        listed = value.get("labels", []) if ok else None
        label.append(value.get("label") or next(filter(None, listed)) if ok else None)
        labels.append(listed)
        props.append(_dump(value["props"]) if ok and "props" in value else None)
    typed = {
        "label": pa.array(label, pa.string()),
        "labels": pa.array(labels, pa.list_(pa.string())),
        "props": pa.array(props, pa.string()),
    }
    yield _part(rows, "node_body", pa.array(reasons, pa.string()), pa.array(failed, pa.string()), typed)


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        line = pc.replace_substring_regex(pc.fill_null(table["line"], ""), "\r\\z", "")
        table = table.set_column(table.column_names.index("line"), "line", line)
        shape = [pc.fill_null(table[c], "") for c in ("format", "layout", "delimiter")]
        names = pc.binary_join_element_wise(*shape, "\x01")
        for name in pc.unique(names).to_pylist():
            rows = table.filter(pc.equal(names, name)).combine_chunks()
            form, layout, delimiter = name.split("\x01")
            if form == "jsonl" and layout == "node_body":
                parts = _jsonl_part(rows)
            elif form == "csv" and layout in LAYOUTS:
                parts = _csv_part(rows, layout, delimiter or ",")
            else:
                parts = iter([_part(rows, layout or None, "unknown_layout")])
            for part in parts:
                yield from part.combine_chunks().to_batches()


def load_records(lines: DataFrame, files: DataFrame) -> DataFrame:
    """All records of `lines`: typed columns where `reason` is null, else the line and the reason.

    ``failed_column`` names the first cell that does not cast. Typed columns are
    those of the record's layout, the others are null.
    """
    newest = F.max(F.struct("loaded_at", "layout", "format", "delimiter")).alias("f")
    shapes = files.groupBy("file_no").agg(newest).select("file_no", "f.layout", "f.format", "f.delimiter")
    records = (
        lines.select("file_no", "line_no", "line")
        .join(shapes, "file_no", "left")
        .where(~(F.col("line_no").eqNullSafe(1) & (F.coalesce("format", F.lit("")) == "csv")))
        .select(F.col("file_no").cast("int"), F.col("line_no").cast("int"), "line", "format", "layout", "delimiter")
    )
    return records.mapInArrow(_load, RESULT_DDL)


def rejected_records(records: DataFrame) -> DataFrame:
    return records.where(F.col("reason").isNotNull()).select("file_no", "line_no", "reason", "failed_column", "line")


def copy_outcomes(records: DataFrame) -> DataFrame:
    good = records.where(F.col("reason").isNull() & (F.col("layout") == "copy_outcome"))
    return good.select("file_no", "line_no", *LAYOUTS["copy_outcome"])


def node_bodies(records: DataFrame) -> DataFrame:
    good = records.where(F.col("reason").isNull() & (F.col("layout") == "node_body"))
    return good.select("file_no", "line_no", "node_id", "label", "labels", "props")
