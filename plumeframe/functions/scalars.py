"""Scalar columns: dates, text, numbers, identifiers, buckets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumeframe.config import SplitDates

# US EPA regions by state name.
EPA_REGIONS = {
    "EPA-1": ["Connecticut", "Maine", "Massachusetts", "New Hampshire", "Rhode Island", "Vermont"],
    "EPA-2": ["New Jersey", "New York", "Puerto Rico", "Virgin Islands"],
    "EPA-3": ["Delaware", "District Of Columbia", "Maryland", "Pennsylvania", "Virginia", "West Virginia"],
    "EPA-4": [
        "Alabama", "Florida", "Georgia", "Kentucky", "Mississippi", "North Carolina", "South Carolina", "Tennessee",
    ],
    "EPA-5": ["Illinois", "Indiana", "Michigan", "Minnesota", "Ohio", "Wisconsin"],
    "EPA-6": ["Arkansas", "Louisiana", "New Mexico", "Oklahoma", "Texas"],
    "EPA-7": ["Iowa", "Kansas", "Missouri", "Nebraska"],
    "EPA-8": ["Colorado", "Montana", "North Dakota", "South Dakota", "Utah", "Wyoming"],
    "EPA-9": ["Arizona", "California", "Hawaii", "Nevada"],
    "EPA-10": ["Alaska", "Idaho", "Oregon", "Washington"],
}

# Size classes in acres (upper bound, label); the last class is open.
SIZE_CLASSES = [(5000.0, "1k-5k"), (20000.0, "5k-20k"), (100000.0, "20k-100k")]
SIZE_CLASS_OPEN = "100k+"

# Class codes of the imager fire mask that mean fire.
FIRE_MASK_CODES = [10, 11, 12, 13, 14, 15, 30, 31, 32, 33, 34, 35]

UNIT_CHANGE_DATE = dt.date(2021, 12, 21)
KG_TO_UG = 1e9


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def missing_to_null(value: Column | str) -> Column:
    """NaN and NULL both mean missing; keep NULL only."""
    number = _col(value).cast("double")
    return F.when(F.isnan(number), F.lit(None)).otherwise(number)


def unquote(text: Column | str) -> Column:
    return F.btrim(F.trim(_col(text)), F.lit('"'))


# ---- dates -----------------------------------------------------------------------------------


def parse_mixed_date(text: Column | str) -> Column:
    """ISO date when it holds a dash, else month/day/year; other text raises."""
    clean = unquote(text)
    return F.when(clean.contains("-"), F.to_date(clean, "yyyy-MM-dd")).otherwise(F.to_date(clean, "M/d/yyyy"))


def parse_datetime(text: Column | str, strict: bool = True) -> Column:
    """RFC 2822, US 12-hour, US 24-hour, ISO - in this order; no zone means UTC; blank is NULL.

    ``strict`` raises on text in none of the forms, else such text gives NULL.
    """
    clean = unquote(text)
    body = F.regexp_replace(clean, r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(body, r"(GMT|UTC|UT|Z|-0000)$", "+0000")
    parsed = F.coalesce(
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(clean, F.lit("M/d/yyyy h:mm:ss a")),
        F.try_to_timestamp(clean, F.lit("M/d/yyyy H:mm:ss")),
        F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(clean)),
    )
    if not strict:
        return parsed
    bad = clean.isNotNull() & (clean != "") & parsed.isNull()
    message = F.concat(F.lit("Unable to parse datetime: "), clean)
    return F.when(bad, F.raise_error(message).cast("timestamp")).otherwise(parsed)


def season(day: Column | str) -> Column:
    month = F.month(_col(day))
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("fall")
    )


def day_number(day: Column | str) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(_col(day).cast("date"))


def day_from_number(number: Column | str) -> Column:
    return F.date_from_unix_date(_col(number).cast("int"))


def acquisition_time(day: Column | str, hhmm: Column | str) -> Column:
    """Date text and HHMM text (not zero-filled) as timestamp; bad text gives NULL."""
    clock = zero_fill(F.trim(_col(hhmm).cast("string")), 4)
    return F.try_to_timestamp(F.concat_ws(" ", F.trim(_col(day).cast("string")), F.substring(clock, 1, 4)), F.lit("yyyy-MM-dd HHmm"))


def epoch_minute(ts: Column | str) -> Column:
    return F.floor(F.unix_micros(_col(ts)) / 60_000_000).cast("bigint")


def timestamp_from_minute(minute: Column | str) -> Column:
    return F.timestamp_seconds(_col(minute) * 60)


def hour_floor(ts: Column | str) -> Column:
    return F.date_trunc("hour", _col(ts))


def trailing_date(identifier: Column | str) -> Column:
    """Date in the last eight digits of an identifier; not a date gives NULL."""
    digits = F.regexp_extract(F.trim(_col(identifier)), r"(\d{8})$", 1)
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd")).cast("date")


def granule_time(key: Column | str, form: str = "year_day") -> Column:
    """Start time written into a granule key.

    ``year_day``  ..._sYYYYDDDHHMMSS...
    ``digits15``  ..._sYYYYMMDDHHMMSSf...
    ``split``     ..._dYYYYMMDD_tHHMMSSf...
    """
    key = _col(key)
    if form == "year_day":
        digits = F.regexp_extract(key, r"_s(\d{13})", 1)
        return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyDDDHHmmss"))
    if form == "digits15":
        digits = F.substring(F.regexp_extract(key, r"_s(\d{15})", 1), 1, 14)
        return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))
    if form == "split":
        pattern = r"_d(\d{8})_t(\d{7})"
        digits = F.concat(F.regexp_extract(key, pattern, 1), F.substring(F.regexp_extract(key, pattern, 2), 1, 6))
        return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))
    raise ValueError(f"unknown granule key form: {form}")


def round_to_step(ts: Column | str, minutes: int = 15) -> Column:
    """Nearest multiple of the step, halves up, on whole seconds."""
    step = minutes * 60
    return F.timestamp_seconds(F.floor((F.unix_seconds(_col(ts)) + step / 2) / step) * step)


def overpass_hours(lon: Column | str) -> tuple[Column, Column]:
    """UTC hour of day of the afternoon and the night crossing at a longitude."""
    shift = _col(lon) / 15.0
    return F.pmod(F.lit(13.5) - shift, F.lit(24.0)), F.pmod(F.lit(1.5) - shift, F.lit(24.0))


def day_plus_hours(day: Column | str, hours: Column) -> Column:
    """Timestamp of a day plus a fractional number of hours, to the microsecond."""
    start = F.unix_micros(_col(day).cast("timestamp"))
    return F.timestamp_micros(start + F.rint(hours * 3_600_000_000.0).cast("bigint"))


def local_day(ts: Column | str, zone: Column | str) -> Column:
    """Civil date of a UTC instant in an IANA zone."""
    return F.to_date(F.from_utc_timestamp(_col(ts), _col(zone)))


def expected_hours(day: Column | str, zone: Column | str) -> Column:
    """Length of a civil day in hours: 23, 24 or 25."""
    start = F.to_utc_timestamp(_col(day).cast("timestamp"), _col(zone))
    end = F.to_utc_timestamp(F.date_add(_col(day), 1).cast("timestamp"), _col(zone))
    return F.floor((F.unix_seconds(end) - F.unix_seconds(start)) / 3600).cast("int")


def date_split(day: Column | str, splits: SplitDates) -> Column:
    day = _col(day)
    return (
        F.when(day.between(F.lit(splits.train_start), F.lit(splits.train_end)), "train")
        .when(day.between(F.lit(splits.val_start), F.lit(splits.val_end)), "val")
        .when(day.between(F.lit(splits.test_start), F.lit(splits.test_end)), "test")
        .otherwise("outside")
    )


# ---- text and identifiers --------------------------------------------------------------------


def zero_fill(text: Column | str, width: int) -> Column:
    """Pad with zeros on the left; longer text stays whole."""
    text = _col(text)
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def station_key(state: Column | str, county: Column | str, site: Column | str) -> Column:
    parts = [(state, 2), (county, 3), (site, 4)]
    return F.concat_ws("-", *[zero_fill(unquote(F.coalesce(_col(c), F.lit(""))), width) for c, width in parts])


def number_from_text(text: Column | str) -> Column:
    """Number with thousands separators; anything else gives NULL."""
    return missing_to_null(F.regexp_replace(F.trim(_col(text)), ",", "").try_cast("double"))


def clean_text(text: Column | str, default: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(F.trim(_col(text)), F.lit("")), F.lit(default))


def first_nonblank(*texts: Column | str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(_col(t)), F.lit("")) for t in texts])


def normalize_id(text: Column | str) -> Column:
    return F.nullif(F.lower(F.btrim(F.trim(_col(text)), F.lit("{}"))), F.lit(""))


def normalize_name(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+", " "))


def epa_region(state: Column | str) -> Column:
    """Region of a state name; unknown and missing states share one label."""
    pairs = [F.lit(x) for region, states in EPA_REGIONS.items() for s in states for x in (s, region)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(state)), F.lit("EPA-unknown"))


def confidence_class(text: Column | str, numeric: bool = True) -> Column:
    """h / n / l by first letter, else by number (80 and 30 are the cuts), else u."""
    clean = F.lower(F.trim(_col(text).cast("string")))
    first = F.substring(clean, 1, 1)
    by_letter = F.when(first.isin("h", "n", "l"), first)
    if not numeric:
        return F.coalesce(by_letter, F.lit("u"))
    number = missing_to_null(clean.try_cast("double"))
    by_number = F.when(number >= 80, "h").when(number >= 30, "n").when(number < 30, "l")
    return F.coalesce(by_letter, by_number, F.lit("u"))


def day_night(text: Column | str) -> Column:
    return F.substring(F.upper(F.trim(_col(text))), 1, 1)


# ---- buckets and numbers ---------------------------------------------------------------------


def size_bucket(acres: Column | str) -> Column:
    acres = _col(acres)
    out = F.lit(SIZE_CLASS_OPEN)
    for bound, label in reversed(SIZE_CLASSES):
        out = F.when(acres < bound, label).otherwise(out)
    return out


def size_bucket_order(bucket: Column | str) -> Column:
    labels = [label for _, label in SIZE_CLASSES] + [SIZE_CLASS_OPEN]
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), _col(bucket)).cast("int")
    return F.when(position > 0, position - 1).otherwise(9)


def incident_size(primary: Column, fallback: Column, require_positive_fallback: bool = True) -> Column:
    second = F.when(fallback > 0, fallback) if require_positive_fallback else fallback
    return F.coalesce(F.when(primary > 0, primary), second)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL when whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def relative_progress(day_offset: Column, active_days: Column) -> Column:
    return day_offset / F.greatest(active_days - 1, F.lit(1))


def progress_bin(progress: Column, bins: int) -> Column:
    """Bin 0..bins-1 of a position in [0, 1]; positions outside fall into the end bins."""
    return F.greatest(F.least(F.floor(progress * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def geo_cell(lat: Column | str, lon: Column | str, step: float = 0.25) -> Column:
    """Cell id from half-even rounding of lat/step and lon/step."""
    return F.concat_ws(
        "_", F.rint(_col(lat) / step).cast("int").cast("string"), F.rint(_col(lon) / step).cast("int").cast("string")
    )


def hour_list(text: Column | str) -> Column:
    """Comma list of hours as sorted distinct integers; outside 0..23 or empty raises."""
    items = F.transform(F.split(_col(text), ","), lambda s: F.trim(s).cast("int"))
    hours = F.array_sort(F.array_distinct(items))
    bad = (F.size(hours) == 0) | F.exists(hours, lambda h: (h < 0) | (h > 23))
    return F.when(bad, F.raise_error(F.concat(F.lit("bad hour list: "), _col(text))).cast("array<int>")).otherwise(hours)


def check_hours(hours: Sequence[int] | None) -> tuple[int, ...] | None:
    """Driver-side form of the same rule for an argument."""
    if hours is None:
        return None
    out = tuple(sorted({int(h) for h in hours}))
    if not out:
        raise ValueError("sample hours must not be empty when given")
    for h in out:
        if not 0 <= h <= 23:
            raise ValueError(f"sample hour must be in 0..23, got {h}")
    return out


def sample_key_hourly(incident: Column | str, run_time: Column | str) -> Column:
    stamp = F.date_format(_col(run_time), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.concat_ws("|", _col(incident).cast("string"), F.lit("hourly"), stamp)


def sample_key_daily(incident: Column | str, day: Column | str, hours: Sequence[int] | Column) -> Column:
    if not isinstance(hours, Column):
        hours = F.lit(",".join(str(h) for h in sorted(hours)))
    return F.concat_ws("|", _col(incident).cast("string"), F.lit("daily"), _col(day).cast("string"), hours)


def sample_key_of_row(
    key: Column, incident: Column, mode: Column, run_date: Column, hours: Column, run_time_text: Column
) -> Column:
    """Key of an index row: as stored, else rebuilt from the other columns."""
    daily = F.concat_ws("|", incident, F.lit("daily"), F.coalesce(run_date, F.lit("")), F.coalesce(hours, F.lit("")))
    hourly = F.concat_ws("|", incident, F.lit("hourly"), F.coalesce(run_time_text, F.lit("")))
    rebuilt = F.when(F.coalesce(mode, F.lit("hourly")).startswith("daily"), daily).otherwise(hourly)
    return F.coalesce(F.when(F.trim(key) != "", key), rebuilt)


def is_upper_air(variable: Column | str, level: Column | str) -> Column:
    return F.lower(_col(level)).endswith("mb") | (F.upper(_col(variable)) == "DZDT")


def harmonize_units(value: Column | str, day: Column | str) -> Column:
    """Mass density in ug/m3: the archive changed unit on one date."""
    return F.when(_col(day) < F.lit(UNIT_CHANGE_DATE), _col(value)).otherwise(_col(value) * KG_TO_UG)


def to_log_space(value: Column | str) -> Column:
    return F.log1p(F.greatest(_col(value), F.lit(0.0)))


def from_log_space(value: Column | str) -> Column:
    return F.expm1(_col(value))


# ---- imager pixels ---------------------------------------------------------------------------


def scale_counts(raw: Column | str, scale: Column, offset: Column, fill: Column | None = None) -> Column:
    """Counts to physical value; invalid counts give NULL.

    With a fill value, fill and negative counts are invalid; without, non-positive and reserved
    (65528 and above) counts are.
    """
    raw = _col(raw)
    bad = ((raw <= 0) | (raw >= 65528)) if fill is None else ((raw == fill) | (raw < 0))
    return F.when(~bad, raw * scale + offset)


def synthetic_green(red: Column, near_infrared: Column, blue: Column) -> Column:
    return red * 0.45 + near_infrared * 0.10 + blue * 0.45


def sun_normalize(reflectance: Column, zenith_degrees: Column) -> Column:
    """Reflectance over the cosine of the sun zenith angle; low sun gives NULL."""
    cosine = F.cos(F.radians(zenith_degrees))
    return F.when(cosine > 0.15, reflectance / cosine)


def display_byte(reflectance: Column, gain: float = 1.6, gamma: float = 2.2) -> Column:
    """Reflectance as 0..255: clip, gain, clip, gamma, half-even rounding; missing is 0."""
    unit = F.least(F.greatest(reflectance, F.lit(0.0)), F.lit(1.0))
    stretched = F.pow(F.least(unit * gain, F.lit(1.0)), F.lit(1.0 / gamma))
    return F.coalesce(F.rint(stretched * 255.0), F.lit(0.0)).cast("int")


def is_fire_pixel(code: Column | str, quality: Column | str) -> Column:
    return _col(code).isin(FIRE_MASK_CODES) & (_col(quality) <= 1)


def is_cloud_pixel(mask: Column | str, quality: Column | str | None = None, levels: int = 2) -> Column:
    """NULL for an invalid pixel, else whether it is cloudy (binary mask, or level 2 and 3 of 4)."""
    mask = _col(mask)
    cloudy = (mask >= 2) if levels == 4 else (mask == 1)
    valid = mask.isNotNull() if quality is None else (_col(quality) != 255)
    return F.when(valid, cloudy)


def is_local_daytime(ts: Column | str, lon: Column | str) -> Column:
    ts = _col(ts)
    # In minutes, a degree is four of them: no bound is missed by the rounding of a quotient.
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.pmod(minute + _col(lon) * 4.0, F.lit(1440.0)).between(420.0, 1080.0)
