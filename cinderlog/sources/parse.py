"""Lines of text to entries: the format is found per line, and each format's reader is a set of column expressions.

Cheap tests (a first letter, a contained byte) stand before patterns in every CASE, so a plain line
costs a few comparisons.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.ids import no_id
from cinderlog.functions.levels import ALL_WORDS, number_level, word_level
from cinderlog.functions.patterns import JavaPattern, to_java
from cinderlog.functions.strptime import read_with
from cinderlog.functions.times import STAMP, epoch_timestamp, read_timestamp
from cinderlog.schema import COLUMNS

# The keys that feed each field, the first that is present wins.
KEYS = {
    "timestamp": ("timestamp", "time", "@timestamp", "ts", "datetime"),
    "level": ("level", "severity", "log_level", "loglevel", "lvl"),
    "message": ("message", "msg", "text", "content"),
    "thread_id": ("thread", "thread_id", "tid", "threadId", "thread_name", "threadName"),
    "correlation_id": ("correlation_id", "correlationId", "request_id", "requestId", "req_id"),
    "trace_id": ("trace_id", "traceId"),
    "span_id": ("span_id", "spanId"),
    "parent_span_id": ("parent_span_id", "parentSpanId"),
    "service_name": ("service", "service_name", "serviceName"),
}
ID_FIELDS = ("thread_id", "correlation_id", "trace_id", "span_id", "parent_span_id", "service_name")
FORMATS = ("Json", "PlainText", "Syslog", "CommonLog", "Logfmt", "Custom", "Unknown")
# Phrases that tell a syslog line's level where no word does.
SYSLOG_PHRASES = {
    "FATAL": ("out of memory", "kill process", "segfault", "kernel panic", "oom-killer"),
    "ERROR": ("failed password", "authentication failure", "invalid user", "connection refused", "permission denied", "not allowed", "fatal:", "error:", "failed to", "unable to", "timed out", "timeout"),
    "WARN": ("warning:", "rate limit", "stopping", "deprecated", "retry"),
    "INFO": ("accepted", "session opened", "session closed", "started", "mounted", "received signal", "listening on", ") cmd"),
}
# Patterns of the formats.
PRIORITY = r"\A<(\d+)>"
BSD = r"\A(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+(?:\[\d+\])?:"
COMMON = r'\A(\S+) \S+ \S+ \[([^\]]+)\] "([^"]+)" (\d+) (\S+)'
PAIR = r'(\w+)=(?:"([^"]*)"|([^\s]+))'
THREAD = (
    r"(?:thread[_-]?(?:id)?|tid)[=:\s]+[a-zA-Z0-9_.-]+"
    rf"|\[(?!(?i:{ALL_WORDS})\])[a-zA-Z0-9_.-]+(?:-thread-\d+)?\]"
    r"|\bpool-\d+-thread-\d+\b|\bThreadPoolExecutor-\d+_\d+\b|\b(?:Main|Worker)Thread(?:-\d+)?\b"
)
CORRELATION = r"(?:correlation[_-]?id|request[_-]?id|req[_-]?id)[=:\s]+([a-zA-Z0-9_-]+)"
TRACE = r"(?:trace[_-]?id|traceId)[=:\s]+([a-fA-F0-9]{16,32})"
SPAN = r"(?:span[_-]?id|spanId)[=:\s]+([a-zA-Z0-9_-]+)"
BLANK = r"(?U)\A[\s\x1c-\x1f\x85 ]*\z"
_HEAD = rf"\A\s*(?:\[{STAMP}(?=\])|{STAMP})[\s\]\-|:]+([A-Za-z]+)(?![\w])"
_HEAD_COLON = r"\A\s*([A-Za-z]+):"
_LEADS = rf"\A\s*(?:\[{STAMP}\]|{STAMP})"
_ANY_LEVEL = rf"\[(?i:{ALL_WORDS})\]|\b(?:{ALL_WORDS})\b"


def some(text: Column) -> Column:
    """Empty as null."""
    return F.when(text != "", text)


def find_timestamp(text: Column) -> Column:
    return read_timestamp(some(F.regexp_extract(text, STAMP, 0)))


def extract_level(text: Column) -> Column:
    """At the head of the line in any case, else the leftmost of a bracketed word (any case) and a word in capitals."""
    leads = text.rlike(_LEADS)
    head = F.when(leads, word_level(F.regexp_extract(text, _HEAD, 1))).otherwise(word_level(F.regexp_extract(text, _HEAD_COLON, 1)))
    return F.coalesce(head, word_level(F.translate(F.regexp_extract(text, _ANY_LEVEL, 0), "[]", "")))


def extract_thread(text: Column) -> Column:
    found = F.regexp_extract(text, THREAD, 0)
    named = F.regexp_extract(found, r"\A(?:thread[_-]?(?:id)?|tid)[=:\s]+([a-zA-Z0-9_.-]+)", 1)
    return some(F.when(found.startswith("["), F.substring(found, 2, 10_000).substr(F.lit(1), F.length(found) - 2)).when(named != "", named).otherwise(found))


def json_text(value: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def json_string(value: Column) -> Column:
    """What a JSON string holds; null for another type."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    """A number's JSON text; null for another type."""
    return F.when((_kind(value) == "BIGINT") | (_kind(value) == "DOUBLE") | _kind(value).startswith("DECIMAL"), F.to_json(value))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: a lambda keeps long expressions from being written out at every use."""
    return F.transform(F.array(value), use)[0]


def first_of(texts: dict[str, Column], read) -> Column:
    """Struct (k, v) of the first key whose text ``read`` gives a value for, else null. Most lines have the first key or none: others are looked at only where they are."""
    (key, text), *rest = texts.items()
    found = F.when(read(text).isNotNull(), F.struct(F.lit(key).alias("k"), read(text).alias("v")))
    if not rest:
        return found
    each = F.array(*[F.struct(F.lit(k).alias("k"), t.alias("t")) for k, t in rest])
    later = F.try_element_at(F.filter(F.transform(each, lambda x: F.struct(x["k"].alias("k"), read(x["t"]).alias("v"))), lambda y: y["v"].isNotNull()), F.lit(1))
    return found.when(F.coalesce(*[t for _, t in rest]).isNotNull(), later)


def _fields_left(fields: Column, taken: list[Column]) -> Column:
    gone = F.array_compact(F.array(*taken))
    return F.map_filter(fields, lambda k, _: ~F.array_contains(gone, k))


def json_object(raw: Column) -> Column:
    """The map of a line that is one JSON object and nothing else (the last of equal keys), else null. Values are variants: only those that are shown become text."""
    t = F.trim(raw)
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    one = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<map<string,variant>>", strict)
    return F.when(t.startswith("{") & t.endswith("}"), F.when(F.size(one) == 1, one[0]))


def _texts(obj: Column) -> Column:
    """The values as JSON text."""
    return F.transform_values(obj, lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def _sorted_object(obj: Column) -> Column:
    """The object as compact JSON text with its keys in order."""
    names = F.array_sort(F.map_keys(obj))
    return F.concat(F.lit("{"), F.array_join(F.transform(names, lambda k: F.concat(json_text(k), F.lit(":"), F.coalesce(F.to_json(obj[k]), F.lit("null")))), ","), F.lit("}"))


def _json() -> dict[str, Column]:
    obj = F.col("_json")
    texts = lambda f: {k: F.try_element_at(obj, F.lit(k)) for k in KEYS[f]}
    # an unlisted word is UNKNOWN; a word under any key beats a number under any other
    words = first_of(texts("level"), lambda t: F.when(_kind(t) == "STRING", F.coalesce(word_level(json_string(t)), F.lit("UNKNOWN"))))
    numbers = first_of(texts("level"), lambda t: number_level(F.when(_kind(t) == "BIGINT", F.try_variant_get(t, "$", "bigint"))))
    out = {
        "timestamp": first_of(texts("timestamp"), lambda t: F.coalesce(read_timestamp(json_string(t)), epoch_timestamp(_number(t)))),
        "level": F.coalesce(words, numbers),
        "message": first_of(texts("message"), json_string),
    }
    return out | {f: first_of(texts(f), lambda t: F.coalesce(json_string(t), _number(t))) for f in ID_FIELDS}


def _plain(text: Column) -> dict[str, Column]:
    return {
        "timestamp": find_timestamp(text),
        "level": extract_level(text),
        "message": text,
        "thread_id": extract_thread(text),
        "correlation_id": some(F.regexp_extract(text, CORRELATION, 1)),
        "trace_id": some(F.regexp_extract(text, TRACE, 1)),
        "span_id": some(F.regexp_extract(text, SPAN, 1)),
    }


def _syslog(raw: Column) -> dict[str, Column]:
    priority = F.regexp_extract(raw, PRIORITY, 1)
    rest = F.regexp_replace(raw, PRIORITY, "")
    low, phrase = F.lower(rest), F.lit(None).cast("string")
    for level, phrases in reversed(SYSLOG_PHRASES.items()):
        said = F.lit(False)
        for p in phrases:
            said = said | low.contains(p)
        phrase = F.when(said, level).otherwise(phrase)
    severity = F.coalesce(priority.try_cast("int"), F.lit(0)).bitwiseAND(7)
    level = F.when(priority != "", F.coalesce(number_level(severity), F.lit("UNKNOWN"))).otherwise(F.coalesce(extract_level(rest), phrase))
    return {"timestamp": find_timestamp(rest), "level": level, "message": F.trim(rest)}


def _common(raw: Column) -> dict[str, Column]:
    part = lambda i: F.regexp_extract(raw, COMMON, i)
    status = F.coalesce(part(4).try_cast("int"), F.lit(0))
    stamp = F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    fields = {"remote_addr": json_text(part(1)), "request": json_text(part(3)), "status": status.cast("string"), "size": json_text(part(5))}
    return {
        "timestamp": F.to_utc_timestamp(stamp, F.current_timezone()).cast("timestamp_ntz"),
        "level": F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO"),
        "message": F.concat_ws(" ", part(1), part(3), part(4)),
        "fields": F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]),
    }


def _logfmt_value(value: Column) -> Column:
    whole = F.when(value.rlike(r"\A[+-]?\d+\z"), value.try_cast("long").cast("string"))
    real = F.when(value.rlike(r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"), value.try_cast("double"))
    real = F.when(F.abs(real) < float("inf"), real.cast("string"))
    return F.coalesce(whole, real, F.when(F.lower(value).isin("true", "false"), F.lower(value)), json_text(value))


def _logfmt(raw: Column) -> dict[str, Column]:
    part = lambda i: F.regexp_extract_all(raw, F.lit(PAIR), F.lit(i))
    keys = part(1)
    pairs = F.arrays_zip(keys.alias("k"), part(2).alias("q"), part(3).alias("u"))
    pairs = F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), F.when(x["u"] != "", x["u"]).otherwise(x["q"]).alias("v"), i.alias("i")))
    # a key written twice keeps its last value
    last = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    prefix = F.regexp_extract(raw, rf"(?s)\A(.*?){PAIR}", 1)
    written = F.col("_pairs")
    texts = lambda f: {k: F.try_element_at(written, F.lit(k)) for k in KEYS[f]}
    same = lambda t: t
    out = {
        "_pairs": last,
        "timestamp": F.coalesce(first_of(texts("timestamp"), read_timestamp)["v"], let(prefix, find_timestamp)),
        "level": F.coalesce(first_of(texts("level"), word_level)["v"], let(prefix, extract_level), F.lit("UNKNOWN")),
        "message": F.coalesce(first_of(texts("message"), same)["v"], raw),
        "fields": F.transform_values(written, lambda _, v: _logfmt_value(v)),
    }
    out |= {f: first_of(texts(f), same)["v"] for f in ID_FIELDS}
    out["thread_id"] = F.coalesce(out["thread_id"], let(prefix, extract_thread))
    return out


def _custom(raw: Column, pattern: JavaPattern, timestamp_format: str | None) -> dict[str, Column]:
    # a group that took no part and one that matched nothing both read as absent
    group = lambda key: some(F.regexp_extract(raw, pattern.text, pattern.groups[key])) if key in pattern.groups else F.lit(None).cast("string")
    loose = lambda v: F.coalesce(
        read_timestamp(v),
        F.when(v.rlike(r"\A\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\z"), F.try_to_timestamp(v, F.lit("y-M-d H:m:s")).cast("timestamp_ntz")),
        F.when(v.rlike(r"\A\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}\z"), F.try_to_timestamp(v, F.lit("d-M-y H:m:s")).cast("timestamp_ntz")),
    )
    stamp = lambda v: F.coalesce(read_with(v, timestamp_format), loose(v)) if timestamp_format else loose(v)
    texts = lambda f: {k: group(k) for k in KEYS[f] if k in pattern.groups}
    readers = {"timestamp": stamp, "level": lambda t: F.when(t.isNotNull(), F.coalesce(word_level(t), F.lit("UNKNOWN")))}
    found = {f: first_of(texts(f), readers.get(f, lambda t: t)) for f in KEYS if texts(f)}
    out = {f: x["v"] for f, x in found.items()}
    out["message"] = F.coalesce(out["message"], raw) if "message" in out else raw
    named = F.create_map(*[x for k in pattern.groups for x in (F.lit(k), group(k))]) if pattern.groups else F.create_map().cast("map<string,string>")
    left = F.map_filter(_fields_left(named, [x["k"] for x in found.values()]) if found else named, lambda _, v: v.isNotNull())
    out["fields"] = F.transform_values(left, lambda _, v: json_text(v))
    return out


def detect(raw: Column, json: Column) -> Column:
    t = F.trim(raw)
    pairs = F.regexp_count(t, F.lit(PAIR)) >= 2
    return (
        F.when(json.isNotNull(), "Json")
        .when(t.startswith("<") & t.rlike(PRIORITY), "Syslog")
        .when(t.rlike(BSD), "Syslog")
        .when(t.contains("[") & t.contains('"') & t.rlike(COMMON), "CommonLog")
        .when(t.contains("=") & pairs, "Logfmt")
        .otherwise("PlainText")
    )


class _Readers(NamedTuple):
    """The steps of a parse as columns: each step reads what the one before adds."""

    json: Column
    format: Column
    pairs: Column
    taken: Column
    entry: list[Column]


@lru_cache(maxsize=64)
def _readers(app: str, force: str | None, custom_regex: str | None, timestamp_format: str | None) -> _Readers:
    """Columns hold names, not tables, so an application builds them once for each way to parse."""
    raw = F.col("raw")
    pattern = to_java(custom_regex) if custom_regex else None
    if pattern:
        found = F.when(raw.rlike(pattern.text), "Custom").otherwise("PlainText")
    elif force is None:
        found = detect(raw, F.col("_json"))
    else:
        fits = {"Json": F.col("_json").isNotNull(), "CommonLog": raw.rlike(COMMON)}.get(force, F.lit(True))
        found = F.when(fits, "PlainText" if force in ("Unknown", "Custom") else force).otherwise("PlainText")
    # a plain line that opens with a priority is syslog after all
    shape = F.when((found == "PlainText") & raw.startswith("<") & raw.rlike(PRIORITY), "Syslog").otherwise(found)
    logfmt, json_found = _logfmt(raw), _json()
    pairs = F.when(F.col("format") == "Logfmt", logfmt.pop("_pairs"))
    taken = F.when(F.col("format") == "Json", F.struct(*[x.alias(f) for f, x in json_found.items()]))
    json = {f: F.col(f"_j.{f}.v") for f in json_found}
    json["message"] = F.coalesce(json["message"], _sorted_object(F.col("_json")))
    json["fields"] = _texts(_fields_left(F.col("_json"), [F.col(f"_j.{f}.k") for f in json_found]))
    readers = {"Json": json, "Syslog": _syslog(raw), "CommonLog": _common(raw), "Logfmt": logfmt, "PlainText": _plain(raw)}
    if pattern:
        readers["Custom"] = _custom(raw, pattern, timestamp_format)
    types = {"timestamp": "timestamp_ntz", "fields": "map<string,string>"}
    entry = {}
    for name in ("timestamp", "level", "message", *ID_FIELDS, "fields"):
        value = F.lit(None).cast(types.get(name, "string"))
        for fmt, reader in readers.items():
            if name in reader:
                value = F.when(F.col("format") == fmt, reader[name].cast(types.get(name, "string"))).otherwise(value)
        if name in ("trace_id", "span_id", "parent_span_id"):
            value = no_id(value)
        if name == "fields":
            value = F.coalesce(value, F.create_map().cast("map<string,string>"))
        entry[name] = value
    reads_json = custom_regex is None and force in (None, "Json")
    return _Readers(json_object(raw) if reads_json else F.lit(None).cast("map<string,variant>"), shape, pairs, taken, [entry.get(c, F.col(c)).alias(c) for c in COLUMNS])


def parse(lines: DataFrame, force: str | None = None, custom_regex: str | None = None, timestamp_format: str | None = None) -> DataFrame:
    """Lines (file, line_number, raw) to entries. ``force`` names one of FORMATS; a line that its reader refuses is plain text.

    With ``custom_regex`` lines that match are Custom; the others are plain text.
    """
    r = _readers(lines.sparkSession.sparkContext.applicationId, force, custom_regex, timestamp_format)
    filled = lines.select("file", "line_number", "raw").where(~F.col("raw").rlike(BLANK))
    # an array of one, exploded: a filter on a column above cannot be written out down here, which would parse a line once a mention
    read = filled.select("*", F.explode(F.array(r.json)).alias("_json"))
    return read.select("*", r.format.alias("format")).select("*", r.pairs.alias("_pairs"), r.taken.alias("_j")).select(*r.entry)
