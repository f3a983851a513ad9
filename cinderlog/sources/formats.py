"""Named regex formats: a library of known ones, and users' own in a YAML file beside their logs."""

from __future__ import annotations

import fnmatch
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from cinderlog.functions.patterns import InvalidPattern, checked
from cinderlog.functions.strptime import BadTimestampFormat, compiled

CONFIG = (".cinderlog", "formats.yaml")


class BadFormats(ValueError):
    """A format file that cannot be used; names the file."""


@dataclass(frozen=True)
class Format:
    regex: str
    timestamp_format: str | None = None
    file_patterns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        checked(self.regex)
        if self.timestamp_format:
            compiled(self.timestamp_format)


# The known formats' patterns. They are listed and tested with, never applied unasked.
BUILTIN = {
    "nginx_access": Format(
        r'(?P<remote_addr>[\d.]+) - (?P<remote_user>\S+) \[(?P<timestamp>[^\]]+)\] "(?P<method>\w+) (?P<path>\S+) \S+" (?P<status>\d+) (?P<body_bytes>\d+) "(?P<referer>[^"]*)" "(?P<message>[^"]*)"',
        "%d/%b/%Y:%H:%M:%S %z", ("access.log", "access.log.*", "nginx_access*.log")),
    "nginx_error": Format(
        r"(?P<timestamp>\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(?P<level>\w+)\] (?P<pid>\d+)#(?P<tid>\d+): (?P<message>.*)",
        "%Y/%m/%d %H:%M:%S", ("error.log", "error.log.*", "nginx_error*.log")),
    "apache_access": Format(
        r'(?P<remote_addr>[\d.]+) \S+ \S+ \[(?P<timestamp>[^\]]+)\] "(?P<method>\w+) (?P<path>\S+) \S+" (?P<status>\d+) (?P<body_bytes>\d+|-)',
        "%d/%b/%Y:%H:%M:%S %z", ("apache_access*.log", "httpd-access*.log")),
    "apache_error": Format(
        r"\[(?P<timestamp>[^\]]+)\] \[(?P<module>\w+):(?P<level>\w+)\] \[pid (?P<pid>\d+)\] (?P<message>.*)",
        None, ("apache_error*.log", "httpd-error*.log")),
    "log4j": Format(
        r"(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) (?P<level>\w+)\s+\[(?P<thread_id>[^\]]+)\] (?P<logger>\S+) - (?P<message>.*)",
        "%Y-%m-%d %H:%M:%S,%f", ("*.log4j", "log4j*.log")),
    "logback": Format(
        r"(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) \[(?P<thread_id>[^\]]+)\] (?P<level>\w+)\s+(?P<logger>\S+) - (?P<message>.*)",
        "%Y-%m-%d %H:%M:%S.%f", ("logback*.log",)),
    "go_slog_text": Format(
        r"time=(?P<timestamp>\S+) level=(?P<level>\w+) (?:source=(?P<source>\S+) )?msg=(?P<message>.*)",
        None, ("*.slog", "slog*.log")),
    "docker_json": Format(
        r'\{"log":"(?P<message>[^"]*)","stream":"(?P<stream>\w+)","time":"(?P<timestamp>[^"]+)"\}',
        None, ("*-json.log",)),
    "syslog_bsd": Format(
        r"(?P<timestamp>\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2}) (?P<hostname>\S+) (?P<program>[\w/.-]+)(?:\[(?P<pid>\d+)\])?: (?P<message>.*)",
        None, ("syslog", "syslog.*", "messages", "messages.*")),
    "systemd_journal": Format(
        r"(?P<timestamp>\w{3} \d{2} \d{2}:\d{2}:\d{2}) (?P<hostname>\S+) (?P<unit>\S+)\[(?P<pid>\d+)\]: (?P<message>.*)",
        None, ("journal*.log",)),
    "python_logging": Format(
        r"(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) (?P<level>\w+)\s+(?P<logger>\S+) (?P<message>.*)",
        "%Y-%m-%d %H:%M:%S,%f", ("python*.log",)),
    "postgresql": Format(
        r"(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3} \w+) \[(?P<pid>\d+)\] (?P<level>\w+): (?P<message>.*)",
        "%Y-%m-%d %H:%M:%S.%f UTC", ("postgresql*.log", "pg*.log")),
    "mysql": Format(
        r"(?P<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z) (?P<thread_id>\d+) \[(?P<level>\w+)\] (?P<message>.*)",
        None, ("mysql*.log", "mysqld*.log")),
    "ruby_logger": Format(
        r"(?P<level>[A-Z]), \[(?P<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+) #(?P<pid>\d+)\]\s+(?P<severity>\w+) -- (?P<logger>\S*): (?P<message>.*)",
        None, ("ruby*.log", "rails*.log")),
}


@dataclass
class UserFormats:
    """Formats of a user's file, in its order, and its correlation rules as read."""

    formats: dict[str, Format] = field(default_factory=dict)
    correlations: dict[str, Any] = field(default_factory=dict)
    path: str | None = None

    def name_for(self, file: str) -> str | None:
        """The first format with a glob that fits the file's own name."""
        name = os.path.basename(file)
        return next((k for k, f in self.formats.items() if any(fnmatch.fnmatch(name, g) for g in f.file_patterns)), None)


def parse_formats(data: Any, path: str | None = None) -> UserFormats:
    where = f"{path}: " if path else ""
    if not isinstance(data or {}, dict):
        raise BadFormats(f"{where}a mapping is expected")
    out = UserFormats(path=path, correlations=(data or {}).get("correlations") or {})
    for name, spec in ((data or {}).get("formats") or {}).items():
        try:
            if not isinstance(spec, dict) or not isinstance(spec.get("regex"), str):
                raise BadFormats("a regex is needed")
            out.formats[name] = Format(spec["regex"], spec.get("timestamp_format"), tuple(spec.get("file_patterns") or ()))
        except (InvalidPattern, BadTimestampFormat, BadFormats) as e:
            raise BadFormats(f"{where}format {name!r}: {e}") from None
    return out


def load_formats(path: str) -> UserFormats:
    import yaml

    try:
        return parse_formats(yaml.safe_load(Path(path).read_text(encoding="utf-8")), path)
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise BadFormats(f"{path}: {e}") from None


def formats_for(file: str) -> UserFormats | None:
    """The format file of the nearest ancestor folder of a log file, if there is one."""
    for folder in Path(file).resolve().parents:
        found = folder.joinpath(*CONFIG)
        if found.is_file():
            return load_formats(str(found))
    return None
