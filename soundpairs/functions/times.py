"""Time arithmetic on epoch milliseconds (long). The session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what counts as ISO date text, and the dashed clock form
ISO_TEXT = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)
DASHED_CLOCK = r"T(\d{2})-(\d{2})-(\d{2})"

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
SAFE_FORMAT = "yyyy-MM-dd'T'HH-mm-ss.SSS'Z'"
STAMP_FORMAT = "yyyy-MM-dd_HH-mm-ss"

MINUTE_MS = 60_000
# the years 1 to 9999: other numbers are no times
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999
DAY_MS = 86_400_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole(a: Column, b: Column) -> Column:
    """Integer quotient, cut toward zero."""
    return F.call_function("div", a, b)


def parse_ms(text: Column | str) -> Column:
    """ISO text to epoch ms, fraction cut to ms; anything else is null."""
    text = col(text)
    return F.when(text.rlike(ISO_TEXT), F.unix_millis(F.try_to_timestamp(text)))


def event_ms(ts: Column | str, playlist_s: Column | str) -> Column:
    """Report time: the ISO text, else the playlist key (epoch seconds), else null.

    A key that is no time of the years 1 to 9999 is null.
    """
    return F.coalesce(parse_ms(ts), legal_ms(F.try_multiply(col(playlist_s).cast("long"), F.lit(1000).cast("long"))))


def legal_ms(ms: Column | str) -> Column:
    return F.when(col(ms).between(FIRST_MS, LAST_MS), col(ms))


def clean_time_text(ts: Column | str) -> Column:
    """Dashed clock to colons."""
    return F.regexp_replace(col(ts), DASHED_CLOCK, "T$1:$2:$3")


def to_utc_ms(ts: Column | str) -> Column:
    """Clip centre in epoch ms; null marks a row error.

    Text that can be a date at all has its clock at a fixed place, so the pattern runs only on
    rows with a dash there. A blank for ``T`` is read as it stands.
    """
    ts = col(ts)
    dashed = F.substring(ts, 14, 1) == "-"
    return parse_ms(F.when(dashed, clean_time_text(ts)).otherwise(ts))


def window_bounds(
    df: DataFrame, buffer_s: float = 30, center: str = "center_ms"
) -> DataFrame:
    """Add ``w0`` and ``w1``, the centre less and plus the buffer."""
    if not 0 <= buffer_s < float("inf"):
        raise ValueError(f"buffer must be finite and not negative: {buffer_s}")
    half = F.lit(round(buffer_s * 1000)).cast("long")
    return df.withColumns({"w0": F.col(center) - half, "w1": F.col(center) + half})


def iso_ms(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(legal_ms(ms)), ISO_FORMAT)


def safe_iso(ms: Column | str) -> Column:
    """ISO text fit for file names: dashes for colons."""
    return F.date_format(F.timestamp_millis(legal_ms(ms)), SAFE_FORMAT)


def name_stamp(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(legal_ms(ms)), STAMP_FORMAT)


def floor_phase(ms: Column | str, step_s: int, phase_s: Column | int) -> Column:
    """Latest grid point (phase + n * step) at or before ``ms``."""
    ms, step, phase = col(ms), F.lit(step_s * 1000).cast("long"), _phase_ms(phase_s)
    return ms - F.pmod(ms - phase, step)


def ceil_phase(ms: Column | str, step_s: int, phase_s: Column | int) -> Column:
    """Earliest grid point (phase + n * step) at or after ``ms``."""
    ms, step, phase = col(ms), F.lit(step_s * 1000).cast("long"), _phase_ms(phase_s)
    return ms + F.pmod(phase - ms, step)


def _phase_ms(phase_s: Column | int) -> Column:
    phase = phase_s if isinstance(phase_s, Column) else F.lit(phase_s)
    return phase.cast("long") * F.lit(1000).cast("long")


def minute_start(ms: Column | str) -> Column:
    ms = col(ms)
    return ms - F.pmod(ms, F.lit(MINUTE_MS).cast("long"))


def day_start(ms: Column | str) -> Column:
    ms = col(ms)
    return ms - F.pmod(ms, F.lit(DAY_MS).cast("long"))


def day_key(ms: Column | str) -> Column:
    """UTC day as ``yyyy-MM-dd``."""
    return F.date_format(F.timestamp_millis(legal_ms(ms)), "yyyy-MM-dd")
