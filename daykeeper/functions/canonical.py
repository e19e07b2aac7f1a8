"""Canonical row payloads: compact JSON with sorted keys, UTF-8, nulls kept.

``canonical_json`` is native and exact for every type except floating point, whose text differs
between JVM and contract; ``canonical_json_exact`` is the Arrow function for schemas with floats.
"""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The JSON short escapes; the other control characters take \\u00xx in lower case.
_SHORT_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_OTHER_CONTROLS = {chr(code): f"\\u{code:04x}" for code in range(32) if chr(code) not in _SHORT_ESCAPES}


# The builders below make SQL text, so that a payload of any width is one call to the JVM.


def sql_text(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + "".join(f"\\u{ord(char):04x}" if char < " " else char for char in escaped) + "'"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _replace_all(text: str, table: dict[str, str]) -> str:
    for found, shown in table.items():
        text = f"replace({text}, {sql_text(found)}, {sql_text(shown)})"
    return text


def _json_string(text: str) -> str:
    plain = _replace_all(text, {"\\": "\\\\", '"': '\\"'})
    lines = _replace_all(plain, _SHORT_ESCAPES)
    rare = _replace_all(lines, _OTHER_CONTROLS)
    special, odd = sql_text('[\\x00-\\x1f"\\\\]'), sql_text("[\\x00-\\x07\\x0b\\x0e-\\x1f]")
    # Most text needs no escape at all: one pattern match settles it.
    escaped = f"CASE WHEN {text} RLIKE {odd} THEN {rare} ELSE {lines} END"
    return f"concat('\"', CASE WHEN {text} RLIKE {special} THEN {escaped} ELSE {text} END, '\"')"


def _timestamp(ts: str, has_zone: bool) -> str:
    """ISO-8601 in UTC with ``Z``; six fraction digits only when the fraction is not zero."""
    if has_zone:
        ts = f"timestampadd(MICROSECOND, unix_micros({ts}), TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    text = f"replace(CAST({ts} AS STRING), ' ', 'T')"
    return f"concat('\"', CASE WHEN length({text}) > 19 THEN rpad({text}, 26, '0') ELSE {text} END, 'Z\"')"


def has_float(data_type: T.DataType) -> bool:
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return True
    if isinstance(data_type, T.StructType):
        return any(has_float(field.dataType) for field in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return has_float(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return has_float(data_type.keyType) or has_float(data_type.valueType)
    return False


def _object(fields: list[tuple[str, str, T.DataType]], depth: int) -> str:
    parts: list[str] = []
    for position, (name, value, data_type) in enumerate(sorted(fields, key=lambda field: field[0])):
        lead = ("{" if position == 0 else ",") + json.dumps(name, ensure_ascii=False) + ":"
        parts += [sql_text(lead), canonical_sql(value, data_type, depth)]
    return f"concat({', '.join(parts)}, '}}')" if parts else "'{}'"


def _plain_decimals() -> bool:
    session = SparkSession.getActiveSession()
    return session is None or session.conf.get("spark.sql.ansi.enabled", "true").lower() == "true"


def canonical_sql(value: str, data_type: T.DataType, depth: int = 0) -> str:
    """SQL of the canonical JSON text of one value; NULL becomes the text ``null``."""
    item = f"x{depth}"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        text = _json_string(value)
    elif isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        text = f"CAST({value} AS STRING)"
    elif isinstance(data_type, (T.DecimalType, T.DateType)):
        if isinstance(data_type, T.DecimalType) and data_type.scale > 6 and not _plain_decimals():
            raise ValueError("decimals of this scale print in scientific form unless spark.sql.ansi.enabled is true")
        text = f"concat('\"', CAST({value} AS STRING), '\"')"
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        text = _timestamp(value, isinstance(data_type, T.TimestampType))
    elif isinstance(data_type, T.NullType):
        return "'null'"
    elif isinstance(data_type, T.StructType):
        fields = [(f.name, f"{value}.{_quoted(f.name)}", f.dataType) for f in data_type.fields]
        text = f"CASE WHEN {value} IS NOT NULL THEN {_object(fields, depth)} END"
    elif isinstance(data_type, T.ArrayType):
        element = canonical_sql(item, data_type.elementType, depth + 1)
        text = f"concat('[', array_join(transform({value}, {item} -> {element}), ','), ']')"
    elif isinstance(data_type, T.MapType):
        key = canonical_sql(f"{item}.key", data_type.keyType, depth + 1)
        held = canonical_sql(f"{item}.value", data_type.valueType, depth + 1)
        pairs = f"transform(map_entries({value}), {item} -> concat('[', {key}, ',', {held}, ']'))"
        text = f"concat('[', array_join({pairs}, ','), ']')"
    else:
        raise TypeError(f"no native canonical form for {data_type.simpleString()}")
    return f"coalesce({text}, 'null')"


def has_binary(data_type: T.DataType) -> bool:
    """Whether bytes occur at any depth."""
    if isinstance(data_type, T.StructType):
        return any(has_binary(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return has_binary(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return has_binary(data_type.keyType) or has_binary(data_type.valueType)
    return isinstance(data_type, T.BinaryType)


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The canonical payload of each row, as one native string expression; bytes, which have no native form, go
    through ``canonical_json_exact``."""
    if any(has_binary(df.schema[name].dataType) for name in columns or df.columns):
        return canonical_json_exact(df, columns)
    schema = {field.name: field.dataType for field in df.schema.fields}
    return F.expr(_object([(name, _quoted(name), schema[name]) for name in columns or df.columns], 0))


def _plain(value):
    # json calls this for values without a native form.
    if isinstance(value, datetime):
        utc = value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)
        return utc.replace(tzinfo=None).isoformat() + "Z"
    if isinstance(value, date):
        return value.isoformat()
    return f"{value:f}" if isinstance(value, Decimal) else str(value)


_encoder = json.JSONEncoder(
    ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False, default=_plain
)


#: What a JSON string escapes, and the first and last microsecond that a ``datetime`` holds.
_SPECIAL = r'[\x00-\x1f"\\]'
_FIRST_MICRO, _LAST_MICRO = ((t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in (datetime.min, datetime.max))


def payload_text(row: dict) -> str | None:
    """Canonical payload of a plain Python row; None when it holds NaN or infinity."""
    try:
        return _encoder.encode(row)
    except ValueError:
        return None


def payload_rows(batch: pa.RecordBatch) -> list[bytes] | None:
    """``payload_text`` of every row of an Arrow batch in UTF-8, made column by column; None when a row holds NaN or
    infinity."""
    names = batch.schema.names
    if not names or len(set(names)) < len(names):
        texts = [payload_text(dict(zip(names, values))) for values in zip(*(column.to_pylist() for column in batch.columns))]
        return None if None in texts else [text.encode() for text in texts]
    parts: list = []
    for name, column in sorted(zip(names, batch.columns), key=lambda field: field[0]):
        texts = _value_texts(column)
        if texts is None:
            return None
        lead = ("," if parts else "{") + json.dumps(name, ensure_ascii=False) + ":"
        parts += [_wide(lead), texts.cast(pa.large_string()).fill_null("null")]
    return pc.binary_join_element_wise(*parts, _wide("}"), _wide("")).cast(pa.large_binary()).to_pylist()


def _wide(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _value_texts(column: pa.Array) -> pa.Array | None:
    """The JSON text of each value as ``_encoder`` has it inside a row, null or ``null`` where there is none; None when
    a value is not finite."""
    kind = column.type
    if pa.types.is_integer(kind) or pa.types.is_boolean(kind):
        return column.cast(pa.string())
    if (pa.types.is_string(kind) or pa.types.is_large_string(kind)) and _is_text(column):
        text = column.cast(pa.large_string())
        if not pc.any(pc.match_substring_regex(text, _SPECIAL)).as_py():
            return _in_quotes(text)
    elif pa.types.is_decimal128(kind) and 0 <= kind.scale <= 6:
        # With more places Arrow writes small values with an exponent.
        return _in_quotes(column.cast(pa.string()))
    elif kind == pa.timestamp("us") and _in_years(column):
        text = pc.replace_substring(column.cast(pa.string()), " ", "T")
        whole = pc.ends_with(text, ".000000")
        return _in_quotes(pc.if_else(whole, pc.utf8_slice_codeunits(text, 0, 19), text), "Z")
    values = column.to_pylist()
    try:
        texts = [_encoder.encode(value) for value in values]
    except ValueError:
        return None
    return pa.array(texts, pa.large_string())


def _is_text(column: pa.Array) -> bool:
    """Whether all bytes are UTF-8; others have no Python value, which is an error."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        return False
    return True


def _in_quotes(text: pa.Array, end: str = "") -> pa.Array:
    return pc.binary_join_element_wise(_wide('"'), text.cast(pa.large_string()), _wide(f'{end}"'), _wide(""))


def _in_years(column: pa.Array) -> bool:
    """Whether all times lie in the years 1 to 9999; others have no Python value either."""
    ends = pc.min_max(column.cast(pa.int64())).as_py()
    return ends["min"] is None or ends["min"] >= _FIRST_MICRO and ends["max"] <= _LAST_MICRO


def canonical_json_exact(df: DataFrame, columns: list[str] | None = None) -> Column:
    """As ``canonical_json`` for any schema, floats included, in Arrow batches.

    The payload is NULL for a row with a NaN or an infinity at any depth.
    """

    names = columns or df.columns

    def encode(rows: pa.Array) -> pa.Array:
        # Column-wise conversion is several times faster than struct by struct.
        columns = [rows.field(i).to_pylist() for i in range(len(names))]
        return pa.array([payload_text(dict(zip(names, values))) for values in zip(*columns)], pa.string())

    # The annotations are text in this module; the UDF kind is inferred from real classes.
    encode.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(T.StringType())(encode)(F.struct(*[F.col(_quoted(name)) for name in names]))


def nonfinite(value: Column, data_type: T.DataType) -> Column:
    """True when a NaN or an infinity occurs at any depth of the value."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
    elif isinstance(data_type, T.StructType) and has_float(data_type):
        bad = F.lit(False)
        for field in data_type.fields:
            if has_float(field.dataType):
                bad = bad | nonfinite(value.getField(field.name), field.dataType)
    elif isinstance(data_type, T.ArrayType) and has_float(data_type):
        bad = F.exists(value, lambda item: nonfinite(item, data_type.elementType))
    elif isinstance(data_type, T.MapType) and has_float(data_type):
        bad = F.exists(F.map_values(value), lambda item: nonfinite(item, data_type.valueType)) | F.exists(
            F.map_keys(value), lambda item: nonfinite(item, data_type.keyType)
        )
    else:
        return F.lit(False)
    return F.coalesce(bad, F.lit(False))
