"""Load and export settings: what a delimited file looks like and how a load behaves."""

from __future__ import annotations

from dataclasses import dataclass, field

# The dialect defaults, load defaults and mode sizes.
DELIMITER = ","
QUOTE = '"'
ESCAPE = "\\"
REJECT_DELIMITER = "\u0001"
BATCH_ROWS = 100
BULK_BATCH_ROWS = 80000
DEFAULT_MODE_BATCH_ROWS = 4000
BULK_THRESHOLD_BYTES = 104857600
ERROR_LIMIT_ROWS = 2000
REPLICATION_CAP = 5
LOAD_MODES = ("default", "bulk", "auto")
EXPORT_MODES = ("default", "bulk")


def _one_char(name: str, value: str) -> None:
    if len(value) != 1:
        raise ValueError(f"{name} must be one character, got {value!r}")


@dataclass(frozen=True)
class LoadSetting:
    delimiter: str = DELIMITER
    quoting: bool = False
    quotechar: str = QUOTE
    escapechar: str = ESCAPE
    header: bool = False
    skip_lines: int | None = None
    multi_line: bool = False
    codec: str | None = None
    null_string: str | None = None
    repair_utf8: bool = False
    truncate: bool = False
    mode: str = "default"
    batch_rows: int | None = None
    bulk_threshold: int = BULK_THRESHOLD_BYTES
    error_tolerance: float | None = None
    error_limit: int | None = None
    check_first: bool = False  # limits are judged before the insert with or without it
    reject_path: str | None = None

    def __post_init__(self) -> None:
        _one_char("delimiter", self.delimiter)
        _one_char("quotechar", self.quotechar)
        _one_char("escapechar", self.escapechar)
        if self.mode not in LOAD_MODES:
            raise ValueError(f"mode {self.mode!r} is not one of {', '.join(LOAD_MODES)}")
        if self.error_tolerance is not None and not 0.0 <= self.error_tolerance <= 1.0:
            raise ValueError("error_tolerance is a ratio between 0 and 1")
        if self.multi_line and not self.quoting:
            raise ValueError("multi_line needs quoting: only a quoted field can hold a line break")

    @property
    def rows_per_batch(self) -> int:
        """Rows a JDBC write sends at once, by mode unless given."""
        return self.batch_rows or (BULK_BATCH_ROWS if self.mode == "bulk" else BATCH_ROWS)

    @property
    def skip_rows(self) -> int:
        """Rows to drop at the top of each file; ``skip_lines`` wins over ``header``."""
        if self.skip_lines is not None:
            return self.skip_lines
        return 1 if self.header else 0


@dataclass(frozen=True)
class ExportSetting:
    delimiter: str = DELIMITER
    quoting: bool = False
    quotechar: str = QUOTE
    escapechar: str = ESCAPE
    header: bool = False
    mode: str = "default"
    codec: str | None = None
    overwrite: bool = False
    replication: int | None = None
    block_size: int | None = None
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _one_char("delimiter", self.delimiter)
        _one_char("quotechar", self.quotechar)
        _one_char("escapechar", self.escapechar)
        if self.mode not in EXPORT_MODES:
            raise ValueError(f"mode {self.mode!r} is not one of {', '.join(EXPORT_MODES)}")
