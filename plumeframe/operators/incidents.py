"""Incident records: from provider features to one clean row per incident."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeframe.functions import geo
from plumeframe.functions.scalars import (
    clean_text,
    first_nonblank,
    incident_size,
    normalize_id,
    number_from_text,
    parse_datetime,
    trailing_date,
)

END_FIELDS = ("attr_FireOutDateTime", "attr_ContainmentDateTime", "attr_ControlDateTime", "poly_PolygonDateTime")
ID_FIELDS = ("attr_UniqueFireIdentifier", "poly_IRWINID", "attr_LocalIncidentIdentifier")


def incident_end(fields: list[Column | str], strict: bool) -> Column:
    """First of several time texts that parses."""
    return F.coalesce(*[parse_datetime(f, strict) for f in fields])


def _blank_to_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _with_bounds(df: DataFrame) -> DataFrame:
    west, south, east, north = geo.ring_bounds("rings")
    return (
        df.withColumn("min_lon", west).withColumn("min_lat", south).withColumn("max_lon", east).withColumn("max_lat", north)
    )


def strict_incidents(
    features: DataFrame, run_start: dt.date, run_end: dt.date, min_acres: float, incident_type: str = "WF"
) -> DataFrame:
    """Features of one type that start inside the run, end, are large enough and have id and shape.

    Unreadable times raise. Duplicate ids stay.
    """
    start = parse_datetime("attr_FireDiscoveryDateTime", strict=True)
    end = incident_end(list(END_FIELDS), strict=True)
    size = incident_size(number_from_text("attr_IncidentSize"), number_from_text("poly_GISAcres"))
    out = (
        features.filter(F.trim("attr_IncidentTypeCategory") == incident_type)
        .withColumn("start_ts", start)
        .withColumn("end_ts", end)
        .withColumn("size_acres", size)
        .withColumn("incident_id", first_nonblank(*ID_FIELDS))
        .withColumn("start_date", F.to_date("start_ts"))
        .withColumn("end_date", F.to_date("end_ts"))
        .filter(F.col("start_date").between(F.lit(run_start), F.lit(run_end)))
        .filter((F.col("end_ts") >= F.col("start_ts")) & (F.col("size_acres") >= min_acres))
        .filter(F.col("incident_id").isNotNull() & (F.size("rings") > 0))
    )
    name = F.trim(F.coalesce(_blank_to_null("attr_IncidentName"), _blank_to_null("poly_IncidentName"), F.lit("Unknown")))
    return _with_bounds(out).select(
        "incident_id",
        name.alias("name"),
        F.lit(incident_type).alias("type"),
        F.trim(F.coalesce("attr_POOState", F.lit(""))).alias("state"),
        "start_ts", "end_ts", "start_date", "end_date", "size_acres",
        "min_lon", "min_lat", "max_lon", "max_lat", "rings",
    )


def analytic_incidents(features: DataFrame, start_year: int, end_year: int, min_acres: float) -> DataFrame:
    """Lenient form for the reports: a missing or early end becomes the start, unreadable times are missing."""
    start = F.to_date(parse_datetime("attr_FireDiscoveryDateTime", strict=False))
    end = F.to_date(incident_end(list(END_FIELDS), strict=False))
    size = incident_size(
        number_from_text("attr_IncidentSize"), number_from_text("poly_GISAcres"), require_positive_fallback=False
    )
    out = (
        features.filter(clean_text("attr_IncidentTypeCategory", "") == "WF")
        .withColumn("start_date", start)
        .filter(F.year("start_date").between(start_year, end_year))
        .withColumn("end_date", F.greatest(F.coalesce(end, F.col("start_date")), F.col("start_date")))
        .withColumn("size_acres", size)
        .withColumn("incident_id", first_nonblank(*ID_FIELDS))
        .filter((F.col("size_acres") >= min_acres) & F.col("incident_id").isNotNull() & (F.size("rings") > 0))
    )
    name = clean_text(F.coalesce(_blank_to_null("attr_IncidentName"), _blank_to_null("poly_IncidentName")))
    return _with_bounds(out).select(
        "incident_id",
        name.alias("name"),
        clean_text("attr_POOState").alias("state"),
        normalize_id(F.coalesce(_blank_to_null("attr_IrwinID"), _blank_to_null("poly_IRWINID"))).alias("irwin_id"),
        "start_date", "end_date", F.lit(False).alias("end_is_proxy"), "size_acres",
        clean_text("attr_FireCauseGeneral").alias("cause_general"),
        clean_text("attr_FireCauseSpecific").alias("cause_specific"),
        clean_text("attr_IncidentTypeKind").alias("incident_kind"),
        clean_text("attr_PredominantFuelGroup").alias("fuel_group"),
        "min_lon", "min_lat", "max_lon", "max_lat", "rings",
        *[c for c in ("seq",) if c in features.columns],
    )


def burned_area_incidents(rows: DataFrame, start_year: int, end_year: int, min_acres: float) -> DataFrame:
    """Second provider: wildfires by ignition date; the end is the image date in the post id, if not before."""
    post = trailing_date("Post_ID")
    return (
        rows.filter(F.lower(F.trim("Incid_Type")) == "wildfire")
        .filter(F.year("Ig_Date").between(start_year, end_year))
        .withColumn("size_acres", number_from_text(F.col("BurnBndAc").cast("string")))
        .withColumn("incident_id", F.nullif(F.trim("Event_ID"), F.lit("")))
        .filter((F.col("size_acres") >= min_acres) & F.col("incident_id").isNotNull())
        .select(
            "incident_id",
            F.trim(F.coalesce(_blank_to_null("Incid_Name"), F.lit("Unknown"))).alias("name"),
            F.when(F.length("incident_id") >= 2, F.substring("incident_id", 1, 2)).alias("state"),
            normalize_id("irwinID").alias("irwin_id"),
            F.col("Ig_Date").alias("start_date"),
            F.when(post >= F.col("Ig_Date"), post).alias("end_date"),
            F.lit(True).alias("end_is_proxy"),
            "size_acres",
            *[c for c in ("rings", "seq") if c in rows.columns],
        )
    )


def global_incidents(rows: DataFrame, year: int, min_acres: float) -> DataFrame:
    """Third provider: box meets the country's envelope, given start year, area from the polygon."""
    boxed = _with_bounds(rows)
    box = ("min_lon", "min_lat", "max_lon", "max_lat")
    return (
        boxed.filter(geo.boxes_intersect(box, geo.COUNTRY_ENVELOPE))
        .filter(F.year("IDate") == year)
        .withColumn("end_date", F.greatest(F.coalesce("FDate", "IDate"), F.col("IDate")))
        .withColumn("size_acres", geo.polygon_acres("rings"))
        .filter(F.col("size_acres") >= min_acres)
        .select(
            F.col("Id").cast("string").alias("incident_id"),
            F.concat(F.lit("incident_"), F.col("Id").cast("string")).alias("name"),
            F.col("IDate").alias("start_date"), "end_date", F.lit(False).alias("end_is_proxy"), "size_acres",
            *box, "rings",
        )
    )


def custom_windows(incidents: DataFrame, pad_days: int, end_cap_days: int, capped: str = "B", padded=("B", "C")) -> DataFrame:
    """Window rules by provider: cap one provider's end, widen two providers' windows."""
    start, end = F.col("start_date"), F.coalesce("end_date", "start_date")
    capped_end = F.greatest(F.least(end, F.date_add(start, end_cap_days)), start)
    end = F.when(F.col("provider") == capped, capped_end).otherwise(end)
    pad = F.when(F.col("provider").isin(*padded), pad_days).otherwise(0)
    return incidents.withColumn("_end", F.date_add(end, pad)).withColumn(
        "start_date", F.date_sub(start, pad)
    ).withColumn("end_date", F.col("_end")).drop("_end")


def fold_duplicates(incidents: DataFrame, larger_wins_ties: bool = True, unknown: str = "Unknown") -> DataFrame:
    """One row per incident id from several perimeters, ``seq`` giving the order they came in.

    Longest name (later on a tie), last known text attributes, earliest start, latest end, largest
    size, shape of the largest (the later or, with ``larger_wins_ties=False``, the earlier on a tie).
    All of it is partial aggregation, so an id with very many perimeters is folded where its rows are.
    """
    known = [c for c in ("state", "irwin_id", "cause_general", "cause_specific", "incident_kind", "fuel_group") if c in incidents.columns]
    seq = F.col("seq")
    tie = seq if larger_wins_ties else -seq
    shape = [c for c in ("rings", "min_lon", "min_lat", "max_lon", "max_lat") if c in incidents.columns]
    aggs = [F.max_by("name", F.struct(F.length("name"), seq)).alias("name")]
    for c in known:
        value = F.nullif(F.col(c), F.lit(unknown))
        last = F.max_by(F.col(c), F.when(value.isNotNull(), seq))
        aggs.append((last if c == "irwin_id" else F.coalesce(last, F.lit(unknown))).alias(c))
    aggs += [
        F.min("start_date").alias("start_date"),
        F.max("end_date").alias("end_date"),
        F.max("size_acres").alias("size_acres"),
    ]
    if shape:
        aggs.append(F.max_by(F.struct(*shape), F.struct(F.col("size_acres"), tie)).alias("_shape"))
    out = incidents.groupBy("incident_id").agg(*aggs)
    return out.select("*", "_shape.*").drop("_shape") if shape else out


def domain_split(incidents: DataFrame, buffer_km: float, domain=geo.GRID_DOMAIN) -> tuple[DataFrame, DataFrame]:
    """Incidents whose buffered projected box meets the grid, and counts of the others by state."""
    box = geo.projected_box("min_lon", "min_lat", "max_lon", "max_lat", buffer_km)
    flagged = incidents.withColumn("_in", geo.boxes_intersect(box, domain))
    dropped = (
        flagged.filter(~F.col("_in"))
        .groupBy(F.coalesce(F.nullif(F.col("state"), F.lit("")), F.lit("NA")).alias("state"))
        .agg(F.count("*").alias("dropped"))
    )
    return flagged.filter("_in").drop("_in"), dropped


def eligible_incidents(incidents: DataFrame, exclude_states=("US-AK", "US-HI"), min_acres=0.0, min_days=1) -> DataFrame:
    days = F.datediff("end_date", "start_date") + 1
    excluded = F.upper(F.coalesce("state", F.lit(""))).isin(*exclude_states)
    return incidents.filter(~excluded & (F.col("size_acres") >= min_acres) & (days >= min_days))


def find_incident(
    incidents: DataFrame,
    incident_id=None,
    name: str | None = None,
    center: tuple[float, float] | None = None,
    date_hint: dt.date | None = None,
) -> DataFrame:
    """One incident: by id; by part of the name (largest); by centre (lat, lon) with a penalty of a
    hundredth of a degree per day off the window; else the largest."""
    largest = [F.col("size_acres").desc(), F.col("incident_id")]
    if incident_id is not None:
        return incidents.filter(F.col("incident_id") == F.lit(incident_id)).limit(1)
    if name:
        return incidents.filter(F.lower("name").contains(name.strip().lower())).orderBy(*largest).limit(1)
    if center is not None:
        lat, lon = center
        clat, clon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
        score = F.hypot(clat - lat, clon - lon)
        if date_hint is not None:
            hint = F.lit(date_hint)
            off = F.least(F.abs(F.datediff(hint, "start_date")), F.abs(F.datediff(hint, "end_date")))
            inside = hint.between(F.col("start_date"), F.col("end_date"))
            score = score + F.when(inside, 0.0).otherwise(off / 100.0)
        return incidents.orderBy(score, F.col("incident_id")).limit(1)
    return incidents.orderBy(*largest).limit(1)


def latest_index(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest row per sample id, then latest row per sample key."""
    for key in ("sample_id", "sample_key"):
        window = Window.partitionBy(key).orderBy(F.col(seq).desc())
        log = log.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")
    return log
